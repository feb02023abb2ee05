from pyspark.sql import functions as F

from claimloom.functions.assemble import assemble
from claimloom.operators import context, layout, tables


def test_zones_include_edges_and_spare_other_types(spark):
    elements = spark.createDataFrame(
        [(1, 1, 1, "char", 10.0, 20.0), (1, 1, 2, "char", 10.1, 20.0), (1, 1, 3, "image", 5.0, 5.0), (1, 2, 4, "line", 5.0, 5.0), (1, 1, 5, "rect", None, None)],
        "doc_id bigint, page int, seq int, object_type string, x0 double, top double",
    )
    zone = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 20.0)] * 3, "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    assert sorted(r.seq for r in layout.outside_zones(elements, zone).collect()) == [2, 3, 4]


def test_zone_position_falls_back_to_y0(spark):
    elements = spark.createDataFrame(
        [(1, 1, 1, "char", 1.0, None, 99.0), (1, 1, 2, "char", 1.0, None, None)],
        "doc_id bigint, page int, seq int, object_type string, x0 double, top double, y0 double",
    )
    zone = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 20.0)], "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    assert [r.seq for r in layout.outside_zones(elements, zone).collect()] == [1]


def test_zone_construction(spark):
    boxes = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0, 4.0)], "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    sizes = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id bigint, page int, width double, height double")
    got = sorted(tuple(r) for r in layout.zones(boxes, sizes).collect())
    assert got == [(1, 1, 0.0, 0.0, 600.0, 50.0), (1, 1, 0.0, 750.0, 600.0, 800.0), (1, 1, 1.0, 2.0, 3.0, 4.0)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page int, text string")


def test_documents(spark):
    given = pages(spark, [(1, 10, "ten"), (1, 2, "two"), (1, 3, ""), (1, 4, None), (1, 5, " "), (2, 1, "")])
    plain = {r.doc_id: (r.raw_text, r.num_pages) for r in layout.documents(given).collect()}
    assert plain[1] == ("\n--- Page 2 ---\n\ntwo\n\n--- Page 5 ---\n\n \n\n--- Page 10 ---\n\nten", 5)
    assert plain[2] == ("", 1)
    seen = {r.doc_id: r.raw_text for r in layout.documents(given, ocr=True).collect()}
    assert seen[1] == "\n--- Page 2 (OCR) ---\n\ntwo\n\n--- Page 10 (OCR) ---\n\nten"


def test_large_documents_are_not_gathered(spark):
    given = pages(spark, [(1, i, "x" * 100) for i in range(50)] + [(2, 1, "small")])
    got = {r.doc_id: (r.raw_text, r.num_pages, r.text_state) for r in layout.documents(given, max_chars=1000).collect()}
    assert got[1] == (None, 50, "oversized") and got[2][0].endswith("small") and got[2][2] == "whole"
    parts = assemble(given, ["doc_id"], ["page"], "text", "", max_chars=1000)
    assert {r.doc_id: (r.n_parts, r.text_state) for r in parts.collect()} == {1: (50, "oversized"), 2: (1, "whole")}
    # Recognised text never stands in for a text because of its size.
    seen = layout.documents(pages(spark, [(1, 1, "seen"), (2, 1, "seen")]), ocr=True)
    chosen = {r.doc_id: (r.raw_text, r.text_state, r.error) for r in layout.with_fallback(layout.documents(given, max_chars=1000), seen).collect()}
    assert chosen[1] == (None, "oversized", "The text does not fit one cell") and chosen[2][0].endswith("seen") and chosen[2][2] is None


def test_a_large_page_makes_its_document_oversized(spark):
    elements = spark.createDataFrame(
        [(1, 1, k, "char", 0.0, 0.0, "x" * 10) for k in range(60)] + [(1, 2, 1, "char", 0.0, 0.0, "y"), (2, 1, 1, "char", 0.0, 0.0, "z")],
        "doc_id bigint, page int, seq int, object_type string, x0 double, top double, text string",
    )
    zones = spark.createDataFrame([], "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    counts = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "doc_id bigint, num_pages bigint")
    got = {r.doc_id: (r.raw_text, r.text_state) for r in layout.extracted(elements, zones, counts, pages(spark, [(3, 1, "seen")]), max_chars=300).collect()}
    assert got == {1: (None, "oversized"), 2: ("\n--- Page 1 ---\n\nz", "whole"), 3: ("\n--- Page 1 (OCR) ---\n\nseen", "whole")}


def test_fallback(spark):
    schema = "doc_id bigint, raw_text string, num_pages bigint"
    long = "x" * 101
    primary = spark.createDataFrame([(1, long, 1), (2, " " + "x" * 100 + " ", 2), (3, "few", 3), (4, None, None), (5, None, None)], schema)
    seen = spark.createDataFrame([(1, "seen", 9), (2, "", 9), (3, None, None), (4, "seen", 9), (6, "only", 1)], schema)
    got = {r.doc_id: (r.raw_text, r.num_pages, r.error is not None) for r in layout.with_fallback(primary, seen).collect()}
    assert got == {
        1: (long, 1, False), 2: ("", 9, False), 3: ("few", 3, False), 4: ("seen", 9, False), 5: (None, None, True), 6: ("only", 1, False)
    }


CELLS = "doc_id bigint, source_page int, table_idx int, row_idx int, col_idx int, value string"


def grid(doc, page, table, rows):
    return [(doc, page, table, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def test_header_names(spark):
    cells = spark.createDataFrame(grid(1, 1, 0, [["a", None, "a", None, "a", "a_1"], list("uvwxyz")]), CELLS)
    names = [r.name for r in tables.header_names(cells).orderBy("col_idx").collect()]
    assert names == ["a", "col", "a_1", "col_1", "a_2", "a_1"]
    # The literal "a_1" collides with the first repeat; the later column wins.
    assert tables.table_rows(cells).first().cells == {"a": "u", "col": "v", "a_1": "z", "col_1": "x", "a_2": "y"}


def test_table_texts(spark):
    rows = (
        grid(1, 1, 0, [["a", "b"], ["1", "x,y"], ["2", None]]) + grid(1, 2, 0, [["b", "c"], ['say "hi"', "3"]])
        + grid(2, 1, 0, [["only", "header"]]) + grid(1, 3, 1, [["a", "a", "a_1"], ["p", "q", "r"]])
    )
    got = {r.doc_id: r.table_text for r in tables.table_texts(spark.createDataFrame(rows, CELLS)).collect()}
    assert got[1] == (
        'source_page,table_id,a,b,c,a_1\n1,p1_t1,1,"x,y",,\n1,p1_t1,2,,,\n2,p2_t1,,"say ""hi""",3,\n3,p3_t2,p,,,r\n'
    )
    assert got[2] == "source_page,table_id,only,header\n"
    heads = {r.doc_id: (r.table_data, r.table_chars) for r in tables.first_table_lines(tables.table_lines(spark.createDataFrame(rows, CELLS)), 3, "more").collect()}
    assert heads == {1: ("\n".join(got[1].split("\n")[:3]) + "\nmore", len(got[1])), 2: (got[2], len(got[2]))}
    counts = {r.doc_id: (r.num_tables, r.num_rows, r.num_columns) for r in tables.table_counts(spark.createDataFrame(rows, CELLS)).collect()}
    assert counts == {1: (3, 4, 4), 2: (1, 0, 2)}


def test_table_fallback(spark):
    first = spark.createDataFrame(grid(1, 1, 0, [["a"], ["1"]]), CELLS)
    second = spark.createDataFrame(grid(1, 1, 0, [["z"], ["9"]]) + grid(2, 1, 0, [["y"], ["8"]]), CELLS)
    assert sorted((r.doc_id, r.value) for r in tables.with_table_fallback(first, second).collect()) == [(1, "1"), (1, "a"), (2, "8"), (2, "y")]


def test_sheets(spark):
    rows = [("b", 1, "S", i, f"r{i}") for i in range(52)] + [("b", 2, "T", i, f"t{i}") for i in range(51)] + [("b", 3, "E", 0, None)]
    sheets = tables.sheet_texts(spark.createDataFrame(rows, "file string, sheet_idx int, sheet string, row_idx int, row_text string"))
    text = {r.sheet: r.text for r in sheets.collect()}
    assert "[NOTE: Only first 50 rows shown for this sheet]" in text["S"] and "r50\n" in text["S"] and "r51" not in text["S"]
    assert "NOTE" not in text["T"] and text["T"].startswith("\n=== Sheet: T ===\n\nt0\nt1\n") and "t50" in text["T"]
    assert text["E"] == "\n=== Sheet: E ===\n\n[Empty Sheet]\n"
    errors = spark.createDataFrame([("c", "bad zip")], "file string, message string")
    books = {r.file: r.text for r in tables.workbook_texts(sheets, errors).collect()}
    assert books["c"] == "[Error reading XLSX: bad zip]" and books["b"].index("Sheet: S") < books["b"].index("Sheet: T")


def test_context(spark):
    df = spark.createDataFrame([("mail", "", None)], "m string, t string, x string")
    row = df.select(context.full_context(F.col("m"), F.col("t"), F.col("x")).alias("c"), *context.model_inputs(F.col("m"), F.col("t"), F.col("x"))).first()
    assert row.c == "mail\n\n=== EXTRACTED TABLES ===\n\n\n=== EXTRACTED XLSX ==="
    assert (row.table_data, row.xlsx_data) == ("No table data available", "No XLSX data provided")
    got = df.select(*context.evaluation_inputs(F.col("m"), F.col("t"), F.col("x"))).first()
    assert (got.table_data, got.xlsx_data) == ("", "No XLSX data provided")


def test_removal_report(spark):
    from claimloom.operators import clean

    text = "\n\n".join(["Subject: x"] * 12 + ["words"])
    df = spark.createDataFrame([(1, text)], "doc_id bigint, raw_text string")
    report = context.removal_report(clean.with_paragraphs(df)).collect()
    assert [r.item_no for r in report] == list(range(1, 11)) and {r.category for r in report} == {"header"}


def test_stored_lengths_spare_the_text(spark, tmp_path):
    given = pages(spark, [(1, 1, "one"), (1, 2, "two"), (2, 1, "x" * 500)]).withColumn("n_chars", F.length("text"))
    given.write.parquet(str(tmp_path / "pages"))
    docs = layout.documents(spark.read.parquet(str(tmp_path / "pages")), max_chars=200)
    assert {r.doc_id: r.raw_text is None for r in docs.collect()} == {1: False, 2: True}
    # Only the scan that joins the pages reads their text.
    plan = docs._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("text#" in s for s in scans) and any("n_chars#" in s and "text#" not in s for s in scans)
