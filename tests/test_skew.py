"""One key holding a third of all rows: results stay whole, and plans stay split."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import config, layout, lookup, tables, usage


@pytest.fixture
def no_broadcast(spark):
    """Small tests would broadcast everything; large data would not."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_hot_page(spark, no_broadcast):
    ids = spark.range(30_000)
    elements = ids.select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("doc_id"),
        F.lit(1).alias("page"), F.col("id").alias("seq"), F.lit("char").alias("object_type"),
        (F.col("id") % 600).cast("double").alias("x0"), (F.col("id") % 800).cast("double").alias("top"), F.lit("t").alias("text"),
    )
    # A third of the zones are copies of one zone on the hot page.
    zones = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("doc_id"), F.lit(1).alias("page"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(600.0).alias("x1"), F.lit(50.0).alias("bottom"),
    )
    kept = layout.outside_zones(elements, zones)
    zoned = {r.doc_id for r in zones.select("doc_id").distinct().collect()}
    expected = sum(1 for i in range(30_000) if not (i % 800 <= 50 and (0 if i % 3 == 0 else i % 500) in zoned))
    assert kept.count() == expected
    # The hot page is too large to gather at this limit; all others are whole.
    pages = layout.page_texts(elements, zones, max_chars=2000)
    assert [r.doc_id for r in pages.where("text is null").collect()] == [0]
    assert pages.agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))).first()[0] == kept.where("doc_id <> 0").count()


def test_hot_table(spark, no_broadcast):
    cells = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("source_page"), F.lit(0).alias("table_idx"),
        F.floor(F.col("id") / 4).cast("int").alias("row_idx"), (F.col("id") % 4).cast("int").alias("col_idx"), F.col("id").cast("string").alias("value"),
    )
    assert tables.table_cells(cells).count() == 20_000 - 4
    assert tables.table_rows(cells).count() == 4999
    lines = tables.numbered_lines(tables.table_lines(cells))
    assert sorted(r.line_no for r in lines.collect()) == list(range(5000))
    assert lines.where("line_no = 4999").first().line == "1,p1_t0".replace("t0", "t1") + ",19996,19997,19998,19999"
    head = tables.first_table_lines(tables.table_lines(cells), 50, "more")
    assert head.first().table_data.endswith("\nmore") and "WindowGroupLimit" in head._jdf.queryExecution().executedPlan().toString()


def test_table_of_many_columns(spark, no_broadcast):
    """A document of 3,000 tables, each with columns of its own."""
    cells = spark.range(12_000).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("source_page"), F.floor(F.col("id") / 4).cast("int").alias("table_idx"),
        F.floor(F.col("id") % 4 / 2).cast("int").alias("row_idx"), (F.col("id") % 2).cast("int").alias("col_idx"), F.concat(F.lit("c"), F.col("id")).alias("value"),
    )
    lines = {r.line_no: r.line for r in tables.numbered_lines(tables.table_lines(cells)).collect()}
    assert len(lines) == 3001 and lines[0].startswith("source_page,table_id,c0,c1,c4,c5") and {x.count(",") for x in lines.values()} == {6001}
    assert lines[3] == "1,p1_t3" + "," * 5 + "c10,c11" + "," * 5994


def test_a_flat_folder(spark, no_broadcast):
    """Very many sheets and documents in one folder: fifty lines, and no limit by size."""
    sheets = spark.range(4000).select(
        F.concat(F.lit("/in/book"), F.lpad(F.floor(F.col("id") / 4).cast("string"), 6, "0"), F.lit(".xlsx")).alias("file"), (F.col("id") % 4).cast("int").alias("sheet_idx"),
        F.concat(F.lit("S"), F.col("id")).alias("sheet"), F.concat(F.lit("\n=== Sheet: S"), F.col("id"), F.lit(" ===\n\nrow\n\n")).alias("text"),
    )
    books = sheets.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder"), F.col("file").alias("workbook")).distinct()
    parts = tables.folder_parts(sheets, books)
    heads = tables.first_sheet_lines(parts, 50, "more")
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()
    found = heads.first()
    whole = "".join(("\n" if k % 4 else "") + f"\n=== Sheet: S{k} ===\n\nrow\n\n" for k in range(4000))
    assert found.xlsx_data == "\n".join(whole.split("\n")[:50]) + "\nmore" and found.xlsx_chars == len(whole.rstrip())
    lines = {r.line_no: r.line for r in tables.folder_lines(parts).collect()}
    assert [lines[k] for k in range(len(lines))] == whole.split("\n")[:-1]


def test_hot_model_and_vendor(spark, no_broadcast):
    documents = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot model").when(F.col("id") % 3 == 1, "none").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("model_name"),
        F.lit("None").alias("extracted_fsns"), F.lit("SELL_SIDE").alias("scheme_type"), F.lit("LS").alias("scheme_subtype"),
        F.when(F.col("id") % 3 == 0, "Hot Brand").otherwise("Unknown Vendor").alias("vendor_name"),
    )
    mapping = spark.range(900).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "Hot  Model").otherwise(F.concat(F.lit("M"), F.col("id") % 50)).alias("model_name"),
        F.lit("t").alias("title"), F.concat(F.lit("F"), F.col("id")).alias("fsn"),
    )
    sets = lookup.code_sets(documents, mapping)
    coded = lookup.with_codes(documents, sets)
    counts = {r.model_name: (r.n, r.codes) for r in coded.groupBy("model_name").agg(F.count("*").alias("n"), F.max("num_codes").alias("codes")).collect()}
    assert counts["hot model"] == (1000, 300) and counts["none"] == (1000, 0) and sum(n for n, _ in counts.values()) == 3000
    brands = spark.createDataFrame([(0, "HotBrand", "40%", "1%", "S")], "row_idx bigint, brand string, dmrp_details string, margin string, sc string")
    enriched = lookup.with_vendor_terms(documents, brands)
    assert enriched.count() == 3000 and enriched.where("enriched is not null").count() == 1000


def test_hot_call(spark):
    messages = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("abcd").alias("text")
    )
    got = usage.message_usage(messages).where("conv_id = 0").first()
    assert (got.total_chars, got.output_chars) == (12_000, 4)
    # Added up before the shuffle.
    plan = usage.message_usage(messages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan


def test_hot_sheet(spark):
    rows = spark.range(10_000).select(
        F.concat(F.lit("b"), F.col("id") % 1).alias("file"), (F.col("id") % 1).cast("int").alias("sheet_idx"), F.concat(F.lit("S"), F.col("id") % 1).alias("sheet"),
        F.col("id").alias("row_idx"), F.col("id").cast("string").alias("row_text"),
    )
    sheets = tables.sheet_texts(rows)
    assert sheets.first().text.count("\n") < 60
    # Rows beyond the limit are dropped before the shuffle.
    assert "WindowGroupLimit" in sheets._jdf.queryExecution().executedPlan().toString()


def test_products_of_a_hot_set(spark, no_broadcast):
    sets = spark.range(2000).select(F.lit("m").alias("model_name"), F.col("id").alias("row_idx"), F.concat(F.lit("F"), F.col("id")).alias("fsn"), F.lit("exact").alias("match"))
    configs = spark.range(50).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("period_no"), F.lit("SS-CP").alias("config_type"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("id") % 2 == 0, "m").alias("code_set"), F.array().cast("array<string>").alias("stated_fsns"),
    )
    assert config.product_rows(configs, sets).count() == 25 * 2000 + 25
