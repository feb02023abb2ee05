"""Extracted tables and workbook sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.assemble import CELL_CHARS, assemble
from claimloom.functions.numbering import numbered
from claimloom.functions.text import WHITE_SPACE, first_lines
from claimloom.session import durable

TABLE_KEYS = ["doc_id", "source_page", "table_idx"]


def table_id(page: Column, table_idx: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("_t"), (table_idx + 1).cast("string"))


def _headers(cells: DataFrame) -> DataFrame:
    """Column names of each table; ``last`` marks the last column of a name."""
    return _with_names(_header_cells(cells))


def _header_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("row_idx") == 0).select(*TABLE_KEYS, "col_idx", F.coalesce(F.col("value"), F.lit("col")).alias("base_name"))


def _with_names(header_cells: DataFrame) -> DataFrame:
    # All windows are of whole tables, so one shuffle serves them, or none where cells come by document.
    table = W.partitionBy(*TABLE_KEYS)
    by_base, by_name = table.orderBy("base_name"), table.orderBy("name")
    return (
        header_cells
        .withColumn("repeat", F.row_number().over(table.orderBy("base_name", "col_idx")) - F.rank().over(by_base))
        .withColumn(
            "name",
            F.when(F.col("repeat") == 0, F.col("base_name")).otherwise(
                F.concat_ws("_", "base_name", F.col("repeat").cast("string"))
            ),
        )
        .withColumn("last", F.row_number().over(table.orderBy("name", F.col("col_idx").desc())) == F.rank().over(by_name))
        .select(*TABLE_KEYS, "col_idx", "name", "last")
    )


def header_names(cells: DataFrame) -> DataFrame:
    """Column names from the first row of each table.

    A missing header is "col"; the k-th repeat of a name gets the suffix ``_k``.
    """
    return _headers(cells).drop("last")


def _named_cells(cells: DataFrame) -> DataFrame:
    return _shown(cells.where(F.col("row_idx") > 0).join(_headers(cells), TABLE_KEYS + ["col_idx"]))


def _shown(named: DataFrame) -> DataFrame:
    return named.select(
        *TABLE_KEYS,
        table_id(F.col("source_page"), F.col("table_idx")).alias("table_id"),
        "row_idx",
        "col_idx",
        "name",
        "value",
        "last",
    )


def table_cells(cells: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Data cells under their column names, one row per cell.

    This long form needs no common schema over tables, and no row or table is ever
    gathered: the header joins on table and column.  ``placed`` are the ``placed_cells`` where they are there already.
    """
    return (_named_cells(cells) if placed is None else _shown(placed)).drop("last")


def table_rows(cells: DataFrame) -> DataFrame:
    """Data rows as map<column name, value>, keyed by document, page, table and row.

    Where a literal header equals a numbered repeat, the later column wins.
    """
    return (
        _named_cells(cells)
        .where("last")
        .groupBy(*TABLE_KEYS, "table_id", "row_idx")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cells"))
    )


def table_counts(cells: DataFrame) -> DataFrame:
    """Tables, data rows and distinct columns per document.

    The number of tables counts those without data rows as well.
    """
    headers = header_names(cells)
    columns = headers.groupBy("doc_id").agg(F.count_distinct("name").alias("num_columns"))
    rows = cells.groupBy("doc_id").agg(
        F.count_distinct("source_page", "table_idx").alias("num_tables"),
        F.count_distinct(
            F.when(F.col("row_idx") > 0, F.struct("source_page", "table_idx", "row_idx"))
        ).alias("num_rows"),
    )
    return rows.join(columns, "doc_id", "left").select(
        "doc_id",
        "num_tables",
        "num_rows",
        F.coalesce("num_columns", F.lit(0).cast("bigint")).alias("num_columns"),
    )


def table_columns(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """The columns of each document's consolidated table: (doc_id, name, place, num_columns).

    They are the union over the document's tables, in order of first appearance (``place`` from
    1).  Only header rows are read, and equal names combine before the shuffle.  ``headers`` are the
    ``document_headers`` where they are there already.
    """
    if headers is not None:
        return headers.where("opens").select("doc_id", "name", "place", "num_columns")
    first = _headers(cells).groupBy("doc_id", "name").agg(F.min(F.struct("source_page", "table_idx", "col_idx")).alias("first"))
    counts = first.groupBy("doc_id").agg(F.count("*").cast("int").alias("num_columns"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("first"))
    return first.select("doc_id", "name", place.alias("place")).join(counts, "doc_id")


def document_headers(cells: DataFrame) -> DataFrame:
    """Names of each table's columns and their places in the document's: (*TABLE_KEYS, col_idx, name, last, opens, place, num_columns).

    ``place`` and ``num_columns`` are those of ``table_columns``, and ``opens`` marks where a name stands first.  Header rows move once, by document, and all
    windows work where they lie.  Written down, for the cells and the dictionary each to read.
    """
    named = _with_names(_header_cells(cells).where(F.col("doc_id").isNotNull()).repartition("doc_id"))
    document, column = W.partitionBy("doc_id"), F.struct("source_page", "table_idx", "col_idx")
    by_name = W.partitionBy("doc_id", "name").orderBy(column)
    first = named.withColumns({"opens": F.row_number().over(by_name) == 1, "_first": F.first(column).over(by_name)})
    placed = first.withColumn("place", F.dense_rank().over(document.orderBy("_first", "name")))
    return durable(placed.withColumn("num_columns", F.max("place").over(document)).drop("_first"))


def placed_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Data cells with the columns of ``document_headers``, written down for the lines and the long form to read."""
    return durable(cells.where(F.col("row_idx") > 0).join(headers.drop("opens"), TABLE_KEYS + ["col_idx"]))


def table_lines(cells: DataFrame, headers: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """All tables of a document as lines of CSV: (doc_id, source_page, table_idx, row_idx, line).

    The first line (NULL in the other keys, which sorts first) names the columns of
    ``table_columns``; a table lacking a column leaves it empty, and the last column of a name
    counts.  A row of a table is all that is brought together; documents of any size stay rows.
    ``headers`` and ``placed`` are ``document_headers`` and ``placed_cells`` where they are there already.
    """
    headers = document_headers(cells) if headers is None else headers
    if placed is None:
        named = headers.select(*TABLE_KEYS, "col_idx", "last", "place", "num_columns")
        placed = cells.where(F.col("row_idx") > 0).join(named, TABLE_KEYS + ["col_idx"])
    # Only the last column of a name moves on; a row without any stays.
    filled = F.when(F.col("last"), F.struct("place", "value"))
    rows = (
        # Cells of a row lie apart before, so lists made there would hold one cell each and be longer than cells.
        placed.select(*TABLE_KEYS, "row_idx", "num_columns", "last", "place", F.coalesce("value", F.lit("")).alias("value"))
        .repartition(*TABLE_KEYS, "row_idx")
        .groupBy(*TABLE_KEYS, "row_idx")
        .agg(F.max("num_columns").alias("n"), F.sort_array(F.collect_list(filled)).alias("_cells"))
    )

    def cell(c: Column, k: Column) -> Column:
        # As many commas as there are columns since the cell before.
        before = F.when(k == 0, F.lit(1)).otherwise(F.get("_cells", k - 1)["place"])
        return F.concat(F.repeat(F.lit(","), c["place"] - before), csv_cell(c["value"]))

    behind = F.col("n") - F.coalesce(F.try_element_at("_cells", F.lit(-1))["place"], F.lit(1))
    body = rows.select(
        *TABLE_KEYS,
        "row_idx",
        F.concat(
            F.col("source_page").cast("string"), F.lit(","), table_id(F.col("source_page"), F.col("table_idx")), F.lit(","),
            F.array_join(F.transform("_cells", cell), ""), F.repeat(F.lit(","), behind),
        ).alias("line"),
    )
    names = table_columns(cells, headers).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("names"))
    head = names.select(
        "doc_id",
        *[F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in ("source_page", "table_idx", "row_idx")],
        F.concat(F.lit("source_page,table_id,"), F.array_join(F.transform("names", lambda c: csv_cell(c["name"])), ",")).alias("line"),
    )
    return head.unionByName(body)


LINE_ORDER = ["source_page", "table_idx", "row_idx"]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of ``table_lines``, numbered from 0 by document; written down."""
    return numbered(lines, ["doc_id"], LINE_ORDER, "line_no").select("doc_id", "line_no", "line")


def first_table_lines(lines: DataFrame, limit: int, suffix: str) -> DataFrame:
    """(doc_id, table_data, table_chars): the text of ``table_lines`` cut to its first lines, and its whole length.

    Ranking stops at the lines that are needed before the shuffle, and lengths add up there.
    """
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(*LINE_ORDER))
    # One line more than is shown tells whether any was left out.
    shown = lines.withColumn("rank", rank).where(F.col("rank") <= limit + 1)
    heads = shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    chars = lines.groupBy("doc_id").agg(F.sum((F.length("line") + 1).cast("bigint")).alias("table_chars"))
    return heads.select("doc_id", first_lines(text, limit, suffix).alias("table_data")).join(chars, "doc_id")


def table_texts(cells: DataFrame) -> DataFrame:
    """All tables of a document as one CSV text: docs(doc_id, table_text).

    For documents whose tables are known to fit one cell; a batch works on ``table_lines``.
    """
    lines = table_lines(cells).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "line"))).alias("lines"))
    return lines.select(
        "doc_id", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("table_text")
    )


def csv_cell(value: Column) -> Column:
    """Quote a CSV value where it has to be."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def with_table_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Cells of the second extractor for the documents in which the first found no table."""
    found = primary.select("doc_id").distinct()
    return primary.unionByName(secondary.join(found, "doc_id", "left_anti"))


def sheet_texts(sheet_rows: DataFrame) -> DataFrame:
    """Text of each sheet: sheets(file, sheet, sheet_idx, text).

    sheet_rows(file, sheet_idx, sheet, row_idx, row_text).  The first row is the header and
    at most 50 data rows follow.  Ranking stops at the rows that are needed before the
    shuffle, so a huge sheet moves no more than a small one.
    """
    keys = ["file", "sheet_idx", "sheet"]
    rank = W.partitionBy(*keys).orderBy("row_idx")
    shown = fixed.SHEET_ROWS + 1
    kept = (
        sheet_rows.withColumn("rank", F.row_number().over(rank))
        # One row more than is shown tells whether any was left out.
        .where(F.col("rank") <= shown + 1)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "row_text")))).alias("rows"),
            F.max("rank").alias("last_rank"),
            F.count("row_text").alias("filled"),
        )
    )
    title = F.concat(F.lit("\n=== Sheet: "), F.col("sheet"), F.lit(" ===\n"))
    note = F.lit(f"[NOTE: Only first {fixed.SHEET_ROWS} rows shown for this sheet]\n")
    body = F.array_join(F.transform("rows", lambda r: r["row_text"]), "\n")
    text = F.when(F.col("filled") == 0, F.concat_ws("\n", title, F.lit("[Empty Sheet]\n"))).otherwise(
        F.concat_ws("\n", title, F.when(F.col("last_rank") > shown, note), body, F.lit("\n"))
    )
    return kept.select(*keys, text.alias("text"))


def folder_parts(sheets: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Sheets of each folder's workbooks: (folder, workbook, sheet_idx, text), in that order.

    ``sheets`` as of ``sheet_texts``, ``workbooks(folder, workbook)``.  The texts of a folder read
    one after the other are what every document of the folder gets.
    """
    sheets = sheets.withColumnRenamed("file", "workbook")
    first = sheets.groupBy("workbook").agg(F.min("sheet_idx").alias("_first"))
    return (
        sheets.join(first, "workbook")
        .withColumn("text", F.concat(F.when(F.col("sheet_idx") > F.col("_first"), "\n").otherwise(""), "text"))
        .join(workbooks, "workbook")
        .select("folder", "workbook", "sheet_idx", "text")
    )


def first_sheet_lines(parts: DataFrame, limit: int, suffix: str) -> DataFrame:
    """(folder, xlsx_data, xlsx_chars) of ``folder_parts``: the first lines, and the length without trailing blanks.

    A sheet has a line at least, so no more sheets than lines are brought together, however many
    a folder holds; lengths add up before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("folder").orderBy("workbook", "sheet_idx"))
    shown = parts.withColumn("rank", rank).where(F.col("rank") <= limit + 1)
    heads = shown.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("texts"))
    text = F.array_join(F.transform("texts", lambda x: x["text"]), "")
    blanks = F.length("text") - F.length(F.rtrim("text", F.lit(WHITE_SPACE)))
    chars = parts.groupBy("folder").agg(
        (F.sum(F.length("text").cast("bigint")) - F.max_by(blanks, F.struct("workbook", "sheet_idx"))).alias("xlsx_chars")
    )
    return heads.select("folder", first_lines(text, limit, suffix).alias("xlsx_data")).join(chars, "folder")


def folder_lines(parts: DataFrame) -> DataFrame:
    """(folder, line_no, line) of ``folder_parts``, numbered from 0 by folder; written down."""
    # A part ends with a break, and the next one goes on behind it.
    split = F.split(F.left("text", F.length("text") - 1), "\n", -1)
    lines = parts.select("folder", "workbook", "sheet_idx", F.posexplode(split).alias("pos", "line"))
    return numbered(lines, ["folder"], ["workbook", "sheet_idx", "pos"], "line_no").select("folder", "line_no", "line")


def workbook_texts(sheets: DataFrame, errors: DataFrame | None = None, max_chars: int = CELL_CHARS) -> DataFrame:
    """Sheets of a workbook in order: workbooks(file, text).

    ``errors(file, message)`` names workbooks that could not be read.
    """
    # The few rows that sheets show are written down: sizes and texts would each rank all rows again.
    texts = assemble(durable(sheets), ["file"], ["sheet_idx"], "text", "\n", max_chars).select("file", "text")
    if errors is None:
        return texts
    failed = errors.select(
        "file", F.concat(F.lit("[Error reading XLSX: "), "message", F.lit("]")).alias("text")
    )
    return texts.join(errors, "file", "left_anti").unionByName(failed)
