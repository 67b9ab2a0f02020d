"""Registered queries over the driver's tables and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; round-trip
queries write to a fresh folder under the shared checkpoint space and read
the result back. The driver tables stand in for the survey table (see
FIXTURES.md): ``lineitem`` / ``orders`` / ``customer`` rows play
respondents, ``part`` plays the variable dictionary and the codebook.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.sqltext import literal_frame
from quire.functions.types import STATA_TO_SQL
from quire.operators import chunks, clean, combine, labels, sections, typing
from quire.plans import convert
from quire.plans import oracle as O
from quire.session import read_table, scratch_path
from quire.sinks import writers
from quire.sources import files, profile
from quire.sources import records as files_records
from quire.streaming.ingest import incremental_ingest, ingest_log, read_ingested

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PRICE_SECTION = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# The four keys repeat at the smallest scale (one pair at sf0.001); the other
# columns complete a total order so positions are defined at every scale.
LINEITEM_ORDER = LINEITEM_KEYS + ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                  "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_SECTION = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_DECLARED = {
    "o_orderkey": "BIGINT",
    "o_custkey": "BIGINT",
    "o_orderstatus": "VARCHAR(1)",
    "o_totalprice": "DOUBLE PRECISION",
    "o_orderdate": "TIMESTAMP",
    "o_orderpriority": "VARCHAR(15)",
}
# Type codes given to the fixture variables by p_size % 8; "str5" is not in
# the dictionary, so it exercises the unmapped path.
FIXTURE_CODES = ["byte", "int", "long", "float", "double", "str20", "strL", "str5"]
# Dirty raw header cells for customer's five columns (None = empty cell).
DIRTY_HEADER = [' c,cust\nkey "id" ', None, '\tc nation\n"key"\t', "c acct bal", "c_mktsegment"]
# Header cells written into a raw CSV export ("" is an empty header cell).
RAW_CSV_HEADER = [" c cust\nkey ", "", 'c,"nation"', "c acct\nbal", "c mkt segment"]
CUSTOMER_RANGES = [("place", "c_name", "c_nationkey"), ("money", "c_acctbal", "c_acctbal"),
                   ("who", "c_name", "c_name")]
PART_RULES = [
    ("hot", "prefix", "hot "),
    ("cold", "prefix", "cold "),
    ("color", "prefix", "red"),
    ("color", "prefix", "blue"),
    ("color", "exclude", "red rod"),
    ("r", "prefix", "r"),
    ("size", "prefix", "small"),
    ("size", "prefix", "large"),
    ("size", "name", "old rod_7"),
    ("size", "name", "new gear_11"),
]
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
# Column kinds for the oracle's text rules ("ts" = timestamp, else plain cast).
KIND = {"o_orderdate": "ts", "ts": "ts", "l_shipdate": "ts"}


def _orders_p_as_null(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


def _fixture_variables(spark: SparkSession, sf: str) -> DataFrame:
    """A variables dictionary grown from ``part``: one variable per part."""
    codes = F.array(*[F.lit(c) for c in FIXTURE_CODES])
    return read_table(spark, sf, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("dataset"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"),
        F.element_at(codes, (F.col("p_size") % 8 + 1).cast("int")).alias("type"),
        F.col("p_partkey").alias("ordinal"),
    )


def _fixture_codebook(spark: SparkSession, sf: str, bad: bool = False) -> str:
    """Write a codebook grown from ``part``: per (brand, block of 1000 keys)
    a heading, then ``code value`` / ``code-"value"`` lines, some padded; with
    ``bad``, a line without a separator after every tenth."""
    part = read_table(spark, sf, "part").select(
        "p_brand", "p_partkey", "p_name", F.expr("p_partkey div 1000").alias("blk"))
    pad = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.lit(""))
    value_text = F.when(
        F.col("p_partkey") % 2 == 0,
        F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name")),
    ).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit('-"'), F.col("p_name"), F.lit('"')))
    values = part.select("p_brand", "blk", F.lit(1).alias("kind"), "p_partkey",
                         F.concat(pad, value_text, pad).alias("text"))
    heads = part.groupBy("p_brand", "blk").agg(F.min("p_partkey").alias("p_partkey")).select(
        "p_brand", "blk", F.lit(0).alias("kind"), "p_partkey",
        F.when(F.col("blk") % 2 == 0, F.concat(F.lit('"'), F.col("p_brand"), F.lit('":')))
        .otherwise(F.concat(F.lit("  "), F.col("p_brand"), F.lit(":"))).alias("text"))
    lines = values.unionByName(heads)
    if bad:
        wrong = F.concat(F.lit("bad"), F.col("p_partkey").cast("string")).alias("text")
        lines = lines.unionByName(part.where("p_partkey % 10 = 0").select("p_brand", "blk", F.lit(2).alias("kind"), "p_partkey", wrong))
    lines = (lines.repartition("p_brand", "blk")
             .sortWithinPartitions("p_brand", "blk", "kind", "p_partkey"))
    path = scratch_path(spark, "codebook")
    writers.write_text(lines, path, "text")
    return path


EMBED_DIM = 64


def _fixture_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table grown from ``embeddings``: one float column per
    dimension, named like multi-select answers (``E__1`` ... ``E__64``)."""
    emb = read_table(spark, sf, "embeddings")
    return emb.select("vec_id", "label",
                      *[F.col("embedding")[i].alias(f"E__{i + 1}") for i in range(EMBED_DIM)])


# --------------------------------------------------------------- queries

def q_scan_null_token(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    path = scratch_path(spark, "null-token")
    writers.write_csv(_orders_p_as_null(spark, sf), path, null_token=files.NULL_TOKEN)
    return files.read_csv(spark, path, schema=orders.schema, null_tokens=[files.NULL_TOKEN])


def q_scan_null_tokens_multi(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    marked = orders.withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", F.lit(files.NULL_TOKEN))
        .when(F.col("o_orderstatus") == "F", F.lit("N/A")).otherwise(F.col("o_orderstatus")))
    path = scratch_path(spark, "null-tokens")
    writers.write_csv(marked, path)
    return files.read_csv(spark, path, schema=orders.schema, null_tokens=[files.NULL_TOKEN, "N/A"])


def q_scan_inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred type and non-null cells of every column of orders, read with no,
    one and two null tokens from files that hold that many."""
    orders, out = read_table(spark, sf, "orders"), []
    part = F.col("o_orderkey").cast("long") % 7
    for n, tokens in enumerate(([], [files.NULL_TOKEN], [files.NULL_TOKEN, "N/A"])):
        marked = orders.select(*(F.col(c).cast("string").alias(c) for c in orders.columns))
        for i, token in enumerate(tokens):
            for c in ("o_custkey", "o_totalprice", "o_orderdate"):
                marked = marked.withColumn(c, F.when(part == i, F.lit(token)).otherwise(F.col(c)))
        path = scratch_path(spark, "inferred")
        writers.write_csv(marked, path)
        df = files.read_csv(spark, path, null_tokens=tokens)
        given = df.agg(*(F.count(c).alias(c) for c in df.columns))
        types = F.create_map(*(F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())))
        long = given.unpivot([], df.columns, "variable", "given")
        out.append(long.select(F.lit(n).alias("tokens"), "variable", types[F.col("variable")].alias("type"), "given"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def q_project_section(spark: SparkSession, sf: str) -> DataFrame:
    return sections.project_section(read_table(spark, sf, "lineitem"), LINEITEM_KEYS, PRICE_SECTION)


def q_section_head(spark: SparkSession, sf: str) -> DataFrame:
    return sections.section_head(read_table(spark, sf, "orders"), ["o_orderkey"], ORDERS_SECTION, 5)


def q_sanitize_cells(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sanitize_cells(read_table(spark, sf, "documents"))


def q_stringify_cells(spark: SparkSession, sf: str) -> DataFrame:
    return clean.stringify_cells(read_table(spark, sf, "events"))


def q_fill_empty(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fill_empty(_orders_p_as_null(spark, sf))


def q_clean_header_csv(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_header_csv(read_table(spark, sf, "customer"), DIRTY_HEADER)


def q_clean_header_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_header_parquet(read_table(spark, sf, "customer"), DIRTY_HEADER)


def q_clean_csv_table(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_csv_table(read_table(spark, sf, "conversations"))


def q_export_csv(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    path = scratch_path(spark, "csv")
    writers.write_csv(docs, path)
    return files_records.read_csv_records(spark, path, schema=docs.schema, null_tokens=[])


def q_table_to_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV conversion end to end: CSV header rules, sanitised cells,
    minimal-quoting CSV, read back as text with empty cells as ''."""
    conv = read_table(spark, sf, "conversations")
    path = scratch_path(spark, "to-csv")
    convert.table_to_csv(conv, path)
    schema = ", ".join(f"`{c}` string" for c in conv.columns)
    return clean.fill_empty(files.read_csv(spark, path, schema=schema, null_tokens=[]))


def q_wide_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """The Parquet conversion on a 66-column table with float cells."""
    return clean.clean_parquet_table(_fixture_wide(spark, sf))


def q_export_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    converted = clean.clean_parquet_table(read_table(spark, sf, "orders"))
    writers.write_parquet(converted, path, compression="zstd", row_group_rows=1000)
    return spark.read.parquet(path)


def q_csv_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """A raw CSV export with a dirty header and a null token, converted to
    all-text Parquet with the header cleaned from its raw row."""
    cust = read_table(spark, sf, "customer").withColumn(
        "c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    raw = cust.toDF(*RAW_CSV_HEADER)
    src = scratch_path(spark, "raw-csv")
    writers.write_csv(raw, src, null_token=files.NULL_TOKEN)
    out = scratch_path(spark, "from-csv")
    convert.csv_to_parquet(spark, src, out)
    return spark.read.parquet(out)


def q_export_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    path = scratch_path(spark, "sheets")
    writers.write_partitioned(orders, path, "o_orderpriority", fmt="csv")
    return files.read_csv(spark, path, schema=orders.schema, null_tokens=[])


def q_tagged_scan(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    path = scratch_path(spark, "tagged")
    writers.write_partitioned(orders, path, "o_orderpriority", fmt="parquet")
    return files.tagged_scan(spark, [f"{path}/o_orderpriority=*"], fmt="parquet", tag="sheet",
                             pattern="/o_orderpriority=([^/]*)/", partition_value=True)


def q_append_chunks(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    early = li.where("l_orderkey % 2 = 0")
    late = li.where("l_orderkey % 2 <> 0 or l_orderkey is null")
    path = scratch_path(spark, "append")
    combine.append_chunks([early, late], path, fmt="parquet")
    return spark.read.parquet(path)


def q_parse_value_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = _fixture_codebook(spark, sf)
    return labels.read_value_labels(spark, path, mode="strict")


def q_label_table_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Codebook -> label table -> CSV (no index column) -> read back."""
    table = labels.read_value_labels(spark, _fixture_codebook(spark, sf), mode="strict")
    path = scratch_path(spark, "labels-csv")
    writers.write_csv(table, path)
    return files.read_csv(spark, path, schema="vallab string, code string, value string", null_tokens=[])


def q_map_types(spark: SparkSession, sf: str) -> DataFrame:
    return typing.map_types(_fixture_variables(spark, sf))


def q_map_types_join(spark: SparkSession, sf: str) -> DataFrame:
    book = literal_frame(spark, list(STATA_TO_SQL.items()), "code string, sql_type string")
    return typing.map_types(_fixture_variables(spark, sf), dictionary=book)


def q_generate_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return typing.generate_ddl(typing.map_types(_fixture_variables(spark, sf)))


def q_generate_ddl_sections(spark: SparkSession, sf: str) -> DataFrame:
    """One statement per dataset and section, each with the respondent key."""
    variables = _fixture_variables(spark, sf)
    sections = variables.select(F.concat(F.lit("S"), (F.col("ordinal") % 3).cast("string")).alias("section"), "name")
    key = variables.select("dataset").distinct().select("dataset", F.lit("resp_id").alias("name"), F.lit("long").alias("type"),
                                                        F.lit(-1).cast("long").alias("ordinal"))
    declared = typing.map_types(variables.unionByName(key))
    return typing.generate_ddl(declared, sections=sections, keys=["resp_id"])


def q_variables_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary file -> DDL text file: the variables are written as CSV in
    (dataset, part key) order, read back with their file position as the
    ordinal, typed, turned into statements, written as text and read back."""
    variables = _fixture_variables(spark, sf).orderBy("dataset", "ordinal").select("dataset", "name", "type")
    vpath = scratch_path(spark, "variables")
    writers.write_csv(variables, vpath)
    declared = typing.map_types(files.read_variables(spark, vpath))
    ddl = typing.generate_ddl(declared)
    dpath = scratch_path(spark, "ddl")
    writers.write_text(ddl, dpath, "ddl")
    return spark.read.text(dpath).withColumnRenamed("value", "ddl")


def q_apply_types(spark: SparkSession, sf: str) -> DataFrame:
    text = clean.stringify_cells(_orders_p_as_null(spark, sf))
    return typing.apply_types(text, ORDERS_DECLARED)


def _orders_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text, some cells not of their declared type."""
    text = clean.stringify_cells(_orders_p_as_null(spark, sf))
    key = F.col("o_orderkey").cast("long")
    return text.withColumns({
        "o_custkey": F.when(key % 11 == 0, F.concat("o_custkey", F.lit("x"))).otherwise(F.col("o_custkey")),
        "o_totalprice": F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(key % 17 == 0, F.concat("o_orderpriority", F.lit(" and more than that"))).otherwise(F.col("o_orderpriority"))})


def q_apply_types_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Refused cells of a typed load, as the load wrote them."""
    return typing.load_typed(_orders_dirty(spark, sf), ORDERS_DECLARED, ["o_orderkey"], scratch_path(spark, "typed")).rejects


def q_apply_types_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells given, typed and rejected in a typed load, and the non-null cells it wrote."""
    got = typing.load_typed(_orders_dirty(spark, sf), ORDERS_DECLARED, ["o_orderkey"], scratch_path(spark, "typed"))
    held = [F.count(c) for c in ORDERS_DECLARED]
    total = held[0]
    for h in held[1:]:
        total = total + h
    return got.data.agg(F.lit(got.rows).cast("long").alias("rows"), F.lit(got.given).cast("long").alias("given"),
                        F.lit(got.typed).cast("long").alias("typed"), F.lit(got.rejected).cast("long").alias("rejected"), total.alias("held"))


def q_label_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Codebook lines without a separator, with the heading above them."""
    lines = files.read_lines(spark, _fixture_codebook(spark, sf, bad=True))
    return labels.load_value_labels(lines, scratch_path(spark, "labels")).rejects


def q_write_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, files, bytes and gb of a write of lineitem."""
    return writers.write_with_report(read_table(spark, sf, "lineitem"), scratch_path(spark, "reported"), options={"compression": "zstd"})


def q_rows_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every file of orders written with one file per priority."""
    path = scratch_path(spark, "per-file")
    writers.write_partitioned(read_table(spark, sf, "orders"), path, "o_orderpriority", fmt="parquet", files_per_value=1)
    found = profile.rows_per_file(spark.read.parquet(path))
    sheet = F.url_decode(F.url_decode(F.regexp_extract("file_path", "/o_orderpriority=([^/]*)/", 1)))
    return found.select(sheet.alias("sheet"), "n_rows")


def q_bytes_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes, files and gb of the orders table as it lies there."""
    return profile.bytes_on_disk(spark, f"{sf.rstrip('/')}/orders.parquet")


def q_section_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of customer against its section map, with their non-null cells."""
    cust = read_table(spark, sf, "customer")
    given = cust.agg(*(F.count(c).alias(c) for c in cust.columns)).unpivot([], cust.columns, "name", "given")
    return sections.section_coverage(spark, cust.columns, CUSTOMER_RANGES, ["c_custkey"]).join(given, "name")


def q_section_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of customer's section map against a header with a column moved."""
    cust = read_table(spark, sf, "customer")
    moved = [c for c in cust.columns if c != "c_acctbal"]
    moved = [moved[0], moved[1], "c_acctbal", *moved[2:]]
    found = sections.section_widths(spark, moved, CUSTOMER_RANGES, {"place": 2, "money": 1, "who": 1})
    return found.withColumn("rows", F.lit(cust.count()).cast("long"))


def q_numeric_or_text(spark: SparkSession, sf: str) -> DataFrame:
    return clean.numeric_or_text(clean.stringify_cells(read_table(spark, sf, "customer")))


def q_sections_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "part").select(
        F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    return sections.sections_by_prefix(names, PART_RULES)


def q_split_sections(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer")
    smap = sections.sections_from_ranges(cust.columns, CUSTOMER_RANGES)
    return sections.sections_long(cust, ["c_custkey"], smap)


def q_section_heads(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer")
    smap = sections.sections_from_ranges(cust.columns, CUSTOMER_RANGES)
    return sections.section_heads(cust, ["c_custkey"], smap, 5)


def q_section_heads_file_order(spark: SparkSession, sf: str) -> DataFrame:
    cust = read_table(spark, sf, "customer")
    smap = sections.sections_from_ranges(cust.columns, CUSTOMER_RANGES)
    return sections.section_heads(cust, ["c_custkey"], smap, 5, file_order=True)


def q_batch_preview_file_order(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.batch_preview_file_order(read_table(spark, sf, "lineitem"), batch_size=1000, max_batches=50)


def q_csv_records(spark: SparkSession, sf: str) -> DataFrame:
    """All texts, line breaks and quotes included, through a raw CSV export."""
    docs = read_table(spark, sf, "documents")
    path = scratch_path(spark, "records")
    writers.write_csv(docs, path)
    return files_records.read_csv_records(spark, path, schema=docs.schema, null_tokens=[])


def q_batch_preview(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.batch_preview(read_table(spark, sf, "lineitem"), LINEITEM_ORDER,
                                batch_size=1000, max_batches=50)


def q_scan_row_cap(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.scan_row_cap(read_table(spark, sf, "lineitem"), 25_000, order_by=LINEITEM_ORDER)


def q_chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_manifest(read_table(spark, sf, "lineitem"), 5000)


def q_dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dataset_profile(spark, {t: read_table(spark, sf, t) for t in TABLE_COLUMNS})


INGEST_BATCHES, INGEST_FILES = 5, 4


def _ingested(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Events that land in five slices of four files and are ingested four files
    at a time; returns the sink and the checkpoint."""
    events = read_table(spark, sf, "events")
    landing, sink, checkpoint = (scratch_path(spark, f"ingest-{x}") for x in ("in", "out", "ckpt"))
    for i in range(INGEST_BATCHES):
        part = events.where(F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(INGEST_BATCHES)) == i)
        part.repartition(INGEST_FILES).write.mode("append").parquet(landing)
    incremental_ingest(spark, landing, events.schema, sink, checkpoint, transform=clean.stringify_cells,
                       max_files_per_trigger=INGEST_FILES)
    return sink, checkpoint


def q_incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return read_ingested(spark, *_ingested(spark, sf)).drop("batch")


def q_ingest_log(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of the ingest with their rows and the running total."""
    return ingest_log(spark, _ingested(spark, sf)[1])


def q_decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    nation = read_table(spark, sf, "nation")
    book = nation.select(F.lit("nation").alias("vallab"),
                         F.col("n_nationkey").cast("string").alias("code"),
                         F.col("n_name").alias("value"))
    return labels.decode_labels(read_table(spark, sf, "customer"), "c_nationkey", book, "nation")


def q_decode_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Decode two columns from a codebook of two value labels (nation names by
    nation key; customer keys that happen to be region keys by region name)."""
    nation = read_table(spark, sf, "nation").select(
        F.lit("nation").alias("vallab"), F.col("n_nationkey").cast("string").alias("code"),
        F.col("n_name").alias("value"))
    region = read_table(spark, sf, "region").select(
        F.lit("region").alias("vallab"), F.col("r_regionkey").cast("string").alias("code"),
        F.col("r_name").alias("value"))
    return labels.decode_columns(read_table(spark, sf, "customer"), {"c_nationkey": "nation", "c_custkey": "region"},
                                 nation.unionByName(region))


def q_section_export(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: section projection of lineitem, cells sanitised, written as
    zstd Parquet, read back whole."""
    li = read_table(spark, sf, "lineitem")
    section = clean.sanitize_cells(sections.project_section(li, LINEITEM_KEYS, PRICE_SECTION),
                                   PRICE_SECTION)
    path = scratch_path(spark, "section")
    writers.write_parquet(section, path, compression="zstd")
    return spark.read.parquet(path)


QUERIES: dict[str, Query] = {
    "scan_null_token": q_scan_null_token,
    "scan_null_tokens_multi": q_scan_null_tokens_multi,
    "scan_inferred_types": q_scan_inferred_types,
    "project_section": q_project_section,
    "section_head": q_section_head,
    "sanitize_cells": q_sanitize_cells,
    "stringify_cells": q_stringify_cells,
    "fill_empty": q_fill_empty,
    "clean_header_csv": q_clean_header_csv,
    "clean_header_parquet": q_clean_header_parquet,
    "clean_csv_table": q_clean_csv_table,
    "export_csv": q_export_csv,
    "table_to_csv": q_table_to_csv,
    "wide_to_text": q_wide_to_text,
    "export_parquet": q_export_parquet,
    "csv_to_parquet": q_csv_to_parquet,
    "export_partitioned": q_export_partitioned,
    "tagged_scan": q_tagged_scan,
    "append_chunks": q_append_chunks,
    "parse_value_labels": q_parse_value_labels,
    "label_table_csv": q_label_table_csv,
    "label_rejects": q_label_rejects,
    "map_types": q_map_types,
    "map_types_join": q_map_types_join,
    "generate_ddl": q_generate_ddl,
    "generate_ddl_sections": q_generate_ddl_sections,
    "variables_ddl": q_variables_ddl,
    "apply_types": q_apply_types,
    "apply_types_rejects": q_apply_types_rejects,
    "apply_types_counts": q_apply_types_counts,
    "numeric_or_text": q_numeric_or_text,
    "sections_by_prefix": q_sections_by_prefix,
    "split_sections": q_split_sections,
    "section_heads": q_section_heads,
    "section_heads_file_order": q_section_heads_file_order,
    "batch_preview_file_order": q_batch_preview_file_order,
    "csv_records": q_csv_records,
    "batch_preview": q_batch_preview,
    "scan_row_cap": q_scan_row_cap,
    "chunk_manifest": q_chunk_manifest,
    "dataset_profile": q_dataset_profile,
    "write_report": q_write_report,
    "rows_per_file": q_rows_per_file,
    "bytes_on_disk": q_bytes_on_disk,
    "section_coverage": q_section_coverage,
    "section_widths": q_section_widths,
    "incremental_ingest": q_incremental_ingest,
    "ingest_log": q_ingest_log,
    "decode_labels": q_decode_labels,
    "decode_columns": q_decode_columns,
    "section_export": q_section_export,
}


# --------------------------------------------------------------- oracles

def _all_cells(table: str, rule: Callable[[str, str], str]) -> str:
    cols = TABLE_COLUMNS[table]
    return "SELECT " + ", ".join(f"{rule(c, KIND.get(c, ''))} AS {c}" for c in cols) + f" FROM {table}"


def _fixture_variables_sql() -> str:
    codes = "[" + ", ".join(O.s(c) for c in FIXTURE_CODES) + "]"
    return (f"SELECT replace(p_brand, '#', '_') AS dataset, 'v' || CAST(p_partkey AS VARCHAR) AS name, "
            f"{codes}[p_size % 8 + 1] AS type, p_partkey AS ordinal FROM part")


def _orders_typed_sql() -> str:
    return ("SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, "
            "o_orderdate, o_orderpriority FROM orders")


def _header_sql(names: list[str]) -> str:
    cols = TABLE_COLUMNS["customer"]
    return "SELECT " + ", ".join(f"{c} AS {O.q(n)}" for c, n in zip(cols, names)) + " FROM customer"


def _prefix_sql() -> str:
    v = "(SELECT p_name || '_' || CAST(p_partkey AS VARCHAR) AS name FROM part)"
    by: dict[str, dict[str, list[str]]] = {}
    for sec, kind, pat in PART_RULES:
        by.setdefault(sec, {}).setdefault(kind, []).append(pat)
    arms = []
    for sec, kinds in by.items():
        inc = [f"starts_with(name, {O.s(p)})" for p in kinds.get("prefix", [])]
        if kinds.get("name"):
            inc.append("name IN (" + ", ".join(O.s(n) for n in kinds["name"]) + ")")
        cond = "(" + " OR ".join(inc) + ")"
        for p in kinds.get("exclude", []):
            cond += f" AND NOT starts_with(name, {O.s(p)})"
        arms.append(f"SELECT name, {O.s(sec)} AS section FROM {v} WHERE {cond}")
    return " UNION ALL ".join(arms)


def _split_sql(source: str = "customer") -> str:
    arms = []
    cols = TABLE_COLUMNS["customer"]
    for sec, first, last in CUSTOMER_RANGES:
        for c in cols[cols.index(first):cols.index(last) + 1]:
            arms.append(f"SELECT c_custkey, {O.s(sec)} AS section, {O.s(c)} AS variable, "
                        f"CAST({c} AS VARCHAR) AS value FROM {source}")
    return " UNION ALL ".join(arms)


def _profile_sql() -> str:
    arms = []
    for t, cols in TABLE_COLUMNS.items():
        arms.append(f"SELECT {O.s(t)} AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
                    f"{len(cols)} AS n_columns, {O.s(','.join(cols[:5]))} AS first_columns FROM {t}")
    return " UNION ALL ".join(arms)


def _inferred_sql() -> str:
    whole = "CASE WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
    arms = []
    for n in range(3):
        for c in TABLE_COLUMNS["orders"]:
            kind = (whole.format(c=c) if c.endswith("key") else {"o_totalprice": "'double'", "o_orderdate": "'timestamp'"}.get(c, "'string'"))
            lost = c in ("o_custkey", "o_totalprice", "o_orderdate") and n
            arms.append(f"SELECT {n} AS tokens, {O.s(c)} AS variable, {kind} AS type, "
                        f"count({c}){f' FILTER (WHERE o_orderkey % 7 >= {n})' if lost else ''} AS given FROM orders")
    return " UNION ALL ".join(arms)


def _ddl_sql(columns: str) -> str:
    """One statement per dataset: name and type of its variables, in their order."""
    return (f"SELECT {columns} 'CREATE TABLE IF NOT EXISTS ' || dataset || ' (' || "
            f"string_agg(name || ' ' || {O.type_case('type')}, ',' ORDER BY ordinal) || ');' AS ddl "
            f"FROM ({_fixture_variables_sql()}) GROUP BY dataset")


#: Refused cells of ``_orders_dirty``: (column, condition, its text).
_DIRTY = [("o_custkey", "o_orderkey % 11 = 0", "CAST(o_custkey AS VARCHAR) || 'x'"), ("o_totalprice", "o_orderkey % 13 = 0", "'n/a'"),
          ("o_orderpriority", "o_orderkey % 17 = 0", "o_orderpriority || ' and more than that'")]


def _rejects_sql() -> str:
    return " UNION ALL ".join(f"SELECT o_orderkey, {O.s(c)} AS variable, {text} AS value, "
                              f"{O.s(ORDERS_DECLARED[c])} AS sql_type FROM orders WHERE {cond}" for c, cond, text in _DIRTY)


def _typed_counts_sql() -> str:
    """Given cells: those with a value, and those that the fixture fills."""
    filled = {c: cond for c, cond, _ in _DIRTY if c == "o_totalprice"}
    value = {"o_orderstatus": "nullif(o_orderstatus, 'P')"}
    given = " + ".join(f"count(CASE WHEN {value.get(c, c)} IS NOT NULL{f' OR {filled[c]}' if c in filled else ''} THEN 1 END)" for c in ORDERS_DECLARED)
    bad = " + ".join(f"count(CASE WHEN {cond}{'' if c in filled else f' AND {c} IS NOT NULL'} THEN 1 END)" for c, cond, _ in _DIRTY)
    return (f"SELECT count(*) AS rows, {given} AS given, ({given}) - ({bad}) AS typed, {bad} AS rejected, ({given}) - ({bad}) AS held FROM orders")


def _coverage_sql() -> str:
    cols, arms = TABLE_COLUMNS["customer"], []
    for i, c in enumerate(cols):
        own = [s for s, a, b in CUSTOMER_RANGES if cols.index(a) <= i <= cols.index(b)]
        status = "key" if c == "c_custkey" else ("uncovered", "ok", "doubled")[min(len(own), 2)]
        arms.append(f"SELECT {O.s(c)} AS name, {i} AS position, {len(own)} AS sections, {O.s(own[0]) if own else 'NULL'} AS section, "
                    f"{O.s(status)} AS status, count({c}) AS given FROM customer")
    return " UNION ALL ".join(arms)


_KEYS = ", ".join(LINEITEM_KEYS)
_ORDER = ", ".join(LINEITEM_ORDER)

ORACLE: dict[str, str] = {
    "scan_null_token": _orders_typed_sql(),
    "scan_null_tokens_multi": (
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus IN ('P', 'F') THEN NULL ELSE o_orderstatus END "
        "AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    "scan_inferred_types": _inferred_sql(),
    "project_section": f"SELECT {_KEYS}, {', '.join(PRICE_SECTION)} FROM lineitem",
    "section_head": f"SELECT o_orderkey, {', '.join(ORDERS_SECTION)} FROM orders ORDER BY o_orderkey LIMIT 5",
    "sanitize_cells": _all_cells("documents", O.sanitize),
    "stringify_cells": _all_cells("events", O.stringify),
    "fill_empty": ("SELECT o_orderkey, o_custkey, coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus, "
                   "o_totalprice, o_orderdate, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders"),
    "clean_header_csv": _header_sql(["c_cust key 'id'", "empty_col_1", "c nation 'key'", "c acct bal",
                                     "c_mktsegment"]),
    "clean_header_parquet": _header_sql(['c,cust_key_"id"', "col_1", 'c_nation_"key"', "c_acct_bal",
                                         "c_mktsegment"]),
    "clean_csv_table": _all_cells("conversations", O.sanitize),
    "export_csv": "SELECT * FROM documents",
    "table_to_csv": _all_cells("conversations", O.sanitize),
    "wide_to_text": ("SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label, "
                     + ", ".join(f"coalesce(CAST(CAST(embedding[{i + 1}] AS DOUBLE) AS VARCHAR), '') AS \"E__{i + 1}\""
                                 for i in range(EMBED_DIM)) + " FROM embeddings"),
    "export_parquet": _all_cells("orders", O.stringify),
    "csv_to_parquet": ("SELECT CAST(c_custkey AS VARCHAR) AS c_cust_key, coalesce(c_name, '') AS col_1, "
                       "CAST(c_nationkey AS VARCHAR) AS \"c,\"\"nation\"\"\", CAST(c_acctbal AS VARCHAR) AS c_acct_bal, "
                       "coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS c_mkt_segment FROM customer"),
    "export_partitioned": "SELECT * FROM orders",
    "tagged_scan": ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
                    "o_orderpriority AS sheet FROM orders"),
    "append_chunks": "SELECT * FROM lineitem",
    "label_table_csv": ("SELECT p_brand AS vallab, CAST(p_partkey AS VARCHAR) AS code, p_name AS value "
                        "FROM part"),
    "parse_value_labels": ("SELECT p_brand AS vallab, CAST(p_partkey AS VARCHAR) AS code, p_name AS value "
                           "FROM part"),
    "map_types": (f"SELECT dataset, name, type, ordinal, {O.type_case('type')} AS sql_type "
                  f"FROM ({_fixture_variables_sql()})"),
    "map_types_join": (f"SELECT dataset, name, type, ordinal, {O.type_case('type')} AS sql_type "
                       f"FROM ({_fixture_variables_sql()})"),
    "variables_ddl": _ddl_sql(""),
    "generate_ddl": _ddl_sql("dataset, dataset AS table_name, count(*) AS n_columns,"),
    "generate_ddl_sections": (
        f"WITH s AS (SELECT *, 'S' || (ordinal % 3) AS section FROM ({_fixture_variables_sql()})) "
        "SELECT dataset, dataset || '_' || section AS table_name, count(*) + 1 AS n_columns, "
        "'CREATE TABLE IF NOT EXISTS ' || dataset || '_' || section || ' (resp_id BIGINT,' || "
        f"string_agg(name || ' ' || {O.type_case('type')}, ',' ORDER BY ordinal) || ');' AS ddl FROM s GROUP BY dataset, section"),
    "apply_types": _orders_typed_sql(),
    "apply_types_rejects": _rejects_sql(),
    "apply_types_counts": _typed_counts_sql(),
    "label_rejects": "SELECT p_brand AS vallab, 'bad' || p_partkey AS line FROM part WHERE p_partkey % 10 = 0",
    "rows_per_file": "SELECT o_orderpriority AS sheet, count(*) AS n_rows FROM orders GROUP BY 1",
    "section_coverage": _coverage_sql(),
    "section_widths": (
        "SELECT * FROM (VALUES (0, 'place', 2, 3, 'moved'), (1, 'money', 1, 1, 'ok'), (2, 'who', 1, 1, 'ok')) "
        "AS t(run, section, declared, found, status), (SELECT count(*) AS rows FROM customer)"),
    "numeric_or_text": _all_cells("customer", lambda c, k: O.numeric_or_text(O.stringify(c, k))),
    "sections_by_prefix": _prefix_sql(),
    "split_sections": _split_sql(),
    "section_heads": _split_sql("(SELECT * FROM customer ORDER BY c_custkey LIMIT 5)"),
    "section_heads_file_order": _split_sql("(SELECT * FROM customer LIMIT 5)"),
    "batch_preview_file_order": (
        "SELECT * EXCLUDE (rn), rn - 1 AS row_index, (rn - 1) // 1000 + 1 AS batch FROM "
        "(SELECT *, row_number() OVER () AS rn FROM lineitem) WHERE rn <= 50000"),
    "csv_records": "SELECT * FROM documents",
    "batch_preview": (
        "SELECT * EXCLUDE (rn), rn - 1 AS row_index, (rn - 1) // 1000 + 1 AS batch FROM "
        f"(SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn <= 50000"),
    "scan_row_cap": f"SELECT * FROM lineitem ORDER BY {_ORDER} LIMIT 25000",
    "chunk_manifest": (
        "WITH c AS (SELECT (row_number() OVER () - 1) // 5000 + 1 AS chunk FROM lineitem) "
        "SELECT chunk, count(*) AS rows, CAST(sum(count(*)) OVER (ORDER BY chunk) AS BIGINT) AS rows_total, "
        f"{len(TABLE_COLUMNS['lineitem'])} AS n_columns FROM c GROUP BY chunk"),
    "dataset_profile": _profile_sql(),
    "incremental_ingest": _all_cells("events", O.stringify),
    "ingest_log": (
        f"SELECT coalesce(event_id, 0) % {INGEST_BATCHES} AS batch, count(*) AS rows, "
        f"CAST(sum(count(*)) OVER (ORDER BY coalesce(event_id, 0) % {INGEST_BATCHES}) AS BIGINT) AS rows_total FROM events GROUP BY 1"),
    "decode_labels": ("SELECT c.*, n.n_name AS c_nationkey_label FROM customer c LEFT JOIN nation n "
                      "ON CAST(c.c_nationkey AS VARCHAR) = CAST(n.n_nationkey AS VARCHAR)"),
    "decode_columns": ("SELECT c.*, n.n_name AS c_nationkey_label, r.r_name AS c_custkey_label FROM customer c "
                       "LEFT JOIN nation n ON CAST(c.c_nationkey AS VARCHAR) = CAST(n.n_nationkey AS VARCHAR) "
                       "LEFT JOIN region r ON CAST(c.c_custkey AS VARCHAR) = CAST(r.r_regionkey AS VARCHAR)"),
    "section_export": (
        f"SELECT {_KEYS}, " + ", ".join(f"{O.sanitize(c, '')} AS {c}" for c in PRICE_SECTION)
        + " FROM lineitem"),
}

#: Bytes that a codec makes are nothing SQL can tell; tests hold them against the files.
NO_ORACLE = {"write_report", "bytes_on_disk"}
assert set(ORACLE) | NO_ORACLE == set(QUERIES), set(ORACLE) ^ set(QUERIES)
assert len(STATA_TO_SQL) == 33
