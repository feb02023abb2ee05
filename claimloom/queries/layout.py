"""Queries over page layout, extracted tables, sheets and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.text import first_lines
from claimloom.operators import context, layout, tables
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query

IN_ZONE = """e.object_type in ('char', 'line', 'rect') and exists (select 1 from zones z
  where z.doc_id = e.doc_id and z.page = e.page
    and e.x0 between z.x0 and z.x1 and e.top between z.top and z.bottom)"""


@query(
    ctes(
        ("elements", fx.ELEMENTS), ("zones", fx.ZONES),
        body=f"select doc_id, page, seq, object_type, x0, top, text from elements e where not ({IN_ZONE})",
    )
)
def outside_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.outside_zones(view(spark, sf_dir, fx.ELEMENTS), view(spark, sf_dir, fx.ZONES))


@query(
    ctes(
        ("boxes", fx.TABLE_BOXES), ("sizes", fx.PAGE_SIZES),
        body="""select doc_id, page, x0, top, x1, bottom from boxes
          union all select doc_id, page, 0.0e0, 0.0e0, width, 50.0e0 from sizes
          union all select doc_id, page, 0.0e0, height - 50.0e0, width, height from sizes""",
    )
)
def page_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.zones(view(spark, sf_dir, fx.TABLE_BOXES), view(spark, sf_dir, fx.PAGE_SIZES))


@query(
    ctes(
        ("elements", fx.ELEMENTS), ("zones", fx.ZONES),
        body=f"""select doc_id, page, string_agg(text, ' ' order by seq) as text, length(string_agg(text, ' ' order by seq)) as n_chars
          from elements e where not ({IN_ZONE}) and text is not null group by doc_id, page""",
    )
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(view(spark, sf_dir, fx.ELEMENTS), view(spark, sf_dir, fx.ZONES))


def _document_sql(marker: str, filled: str) -> str:
    return f"""select doc_id, coalesce(string_agg(chr(10) || '--- Page ' || page || '{marker} ---' || chr(10) || chr(10) || text,
      chr(10) order by page) filter (where {filled}), '') as raw_text, count(*) as num_pages, 'whole' as text_state from pages_of group by doc_id"""


FILLED = "text <> ''"
READABLE = f"{sql.strip('text')} <> ''"


@query(ctes(("pages_of", fx.PAGE_TEXTS), body=_document_sql("", FILLED)))
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.documents(view(spark, sf_dir, fx.PAGE_TEXTS))


@query(ctes(("pages_of", fx.PAGE_TEXTS), body=_document_sql(" (OCR)", READABLE)))
def recognised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.documents(view(spark, sf_dir, fx.PAGE_TEXTS), ocr=True)


# Extracted texts long, short, failed and absent against recognised ones.
_PRIMARY = """select doc_id, case doc_id % 5 when 0 then text when 1 then concat(' ', source, ' ') when 2 then null else text end as raw_text, doc_id % 3 + 1 as num_pages from documents"""
_RECOGNISED = """select doc_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else concat('seen ', text) end as raw_text, doc_id % 3 + 2 as num_pages from documents"""


@query(
    ctes(
        ("p", _PRIMARY), ("r", _RECOGNISED),
        ("both_texts", """select coalesce(p.doc_id, r.doc_id) as doc_id, p.raw_text as pt, r.raw_text as rt,
            p.num_pages as pn, r.num_pages as rn from p full join r on p.doc_id = r.doc_id"""),
        body=f"""select doc_id,
          case when length({sql.strip('pt')}) > {fixed.MINIMUM_TEXT} then pt when rt is not null then rt else pt end as raw_text,
          case when length({sql.strip('pt')}) > {fixed.MINIMUM_TEXT} then pn when rt is not null then rn else pn end as num_pages,
          case when pt is null and rt is null then 'failed' else 'whole' end as text_state,
          case when pt is null and rt is null then 'All extraction methods failed' end as error from both_texts""",
    )
)
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_fallback(view(spark, sf_dir, _PRIMARY), view(spark, sf_dir, _RECOGNISED))


# Documents of which one in five cannot be opened, and recognised pages of one in three.
_OPENED = "select o_orderkey as doc_id, cast(3 as bigint) as num_pages from orders where o_orderkey % 5 <> 0"
_SEEN_PAGES = """select o_orderkey as doc_id, o_custkey % 2 + 1 as page, case when o_orderkey % 6 = 0 then ' ' else concat('seen ', o_orderpriority) end as text
  from orders where o_orderkey % 3 = 0"""


@query(
    ctes(
        ("elements", fx.ELEMENTS), ("zones", fx.ZONES), ("opened", _OPENED), ("seen", _SEEN_PAGES),
        ("texts", f"""select doc_id, page, string_agg(text, ' ' order by seq) as text from elements e
          where not ({IN_ZONE}) and text is not null group by doc_id, page"""),
        ("joined", """select doc_id, string_agg(chr(10) || '--- Page ' || page || ' ---' || chr(10) || chr(10) || text, chr(10) order by page) as text
          from texts where text <> '' group by doc_id"""),
        ("p", "select o.doc_id, num_pages, coalesce(text, '') as raw_text from opened o left join joined j on o.doc_id = j.doc_id"),
        ("r", """select doc_id, coalesce(string_agg(chr(10) || '--- Page ' || page || ' (OCR) ---' || chr(10) || chr(10) || text, chr(10) order by page)
          filter (where trim(text) <> ''), '') as raw_text, count(*) as num_pages from seen group by doc_id"""),
        ("both_texts", """select coalesce(p.doc_id, r.doc_id) as doc_id, p.raw_text as pt, r.raw_text as rt,
          p.num_pages as pn, r.num_pages as rn from p full join r on p.doc_id = r.doc_id"""),
        body=f"""select doc_id, case when length({sql.strip('pt')}) > {fixed.MINIMUM_TEXT} or rt is null then pt else rt end as raw_text,
          case when length({sql.strip('pt')}) > {fixed.MINIMUM_TEXT} or rt is null then pn else rn end as num_pages,
          'whole' as text_state, cast(null as varchar) as error from both_texts""",
    )
)
def extracted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from their elements, as a batch wants them."""
    return layout.extracted(*[view(spark, sf_dir, x) for x in (fx.ELEMENTS, fx.ZONES, _OPENED, _SEEN_PAGES)])


# --- tables ---------------------------------------------------------------------------

HEADERS = """select doc_id, source_page, table_idx, col_idx, case when k = 0 then base else base || '_' || k end as name
  from (select *, row_number() over (partition by doc_id, source_page, table_idx, base order by col_idx) - 1 as k
    from (select *, coalesce(value, 'col') as base from cells where row_idx = 0))"""
BODY_CELLS = """select c.doc_id, c.source_page, c.table_idx, 'p' || c.source_page || '_t' || (c.table_idx + 1) as table_id,
  c.row_idx, c.col_idx, h.name, c.value
  from cells c join headers h on c.doc_id = h.doc_id and c.source_page = h.source_page and c.table_idx = h.table_idx and c.col_idx = h.col_idx
  where c.row_idx > 0"""
# One cell per name and row: the later column wins.
ROW_CELLS = """select * from body_cells qualify row_number() over (
  partition by doc_id, source_page, table_idx, row_idx, name order by col_idx desc) = 1"""
TABLE_CTES = [("cells", fx.CELLS), ("headers", HEADERS), ("body_cells", BODY_CELLS), ("row_cells", ROW_CELLS)]


def _csv(x: str) -> str:
    return f"""case when {sql.matches(x, '[",' + chr(13) + chr(10) + ']')} then '"' || replace({x}, '"', '""') || '"' else {x} end"""


TABLE_TEXT = [
    *TABLE_CTES,
    ("columns_of", """select doc_id, name, row_number() over (partition by doc_id order by sp, ti, ci) as place from
      (select doc_id, name, min(source_page) as sp, arg_min(table_idx, source_page * 1000000 + table_idx) as ti,
        arg_min(col_idx, (source_page * 1000000 + table_idx) * 1000 + col_idx) as ci from headers group by doc_id, name)"""),
    ("rows_of", "select distinct doc_id, source_page, table_idx, table_id, row_idx from body_cells"),
    ("grid", """select r.*, c.place, coalesce(b.value, '') as value from rows_of r join columns_of c on r.doc_id = c.doc_id
      left join row_cells b on b.doc_id = r.doc_id and b.source_page = r.source_page and b.table_idx = r.table_idx
        and b.row_idx = r.row_idx and b.name = c.name"""),
    ("csv_lines", f"""select doc_id, source_page, table_idx, row_idx,
        source_page || ',' || table_id || ',' || string_agg({_csv('value')}, ',' order by place) as line
      from grid group by doc_id, source_page, table_idx, table_id, row_idx
      union all select doc_id, -1, -1, -1, 'source_page,table_id,' || string_agg({_csv('name')}, ',' order by place) from columns_of group by doc_id"""),
    ("table_text", """select doc_id, string_agg(line, chr(10) order by source_page, table_idx, row_idx) || chr(10) as table_text
      from csv_lines group by doc_id"""),
]


@query(ctes(*TABLE_CTES, body="select doc_id, source_page, table_idx, col_idx, name from headers"))
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_names(fx.cells(spark, sf_dir))


@query(ctes(*TABLE_CTES, body="select doc_id, source_page, table_idx, table_id, row_idx, col_idx, name, value from body_cells"))
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_cells(fx.cells(spark, sf_dir))


@query(
    ctes(
        *TABLE_CTES,
        body="""select doc_id, source_page, table_idx, table_id, row_idx,
          string_agg(name || '=' || coalesce(value, ''), ';' order by name) as cells from row_cells
        group by doc_id, source_page, table_idx, table_id, row_idx""",
    )
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(
        F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    return tables.table_rows(fx.cells(spark, sf_dir)).withColumn("cells", F.array_join(F.sort_array(pairs), ";"))


@query(
    ctes(
        *TABLE_CTES,
        body="""select c.doc_id, count(distinct (source_page, table_idx)) as num_tables,
          count(distinct case when row_idx > 0 then (source_page, table_idx, row_idx) end) as num_rows,
          any_value(n) as num_columns from cells c
          join (select doc_id, count(distinct name) as n from headers group by doc_id) h on c.doc_id = h.doc_id group by c.doc_id""",
    )
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_counts(fx.cells(spark, sf_dir))


@query(
    ctes(
        *TABLE_TEXT,
        body="""select o.o_orderkey as doc_id, coalesce(n, 0) as num_tables,
          case when n is null then 'source_page,table_id,note' || chr(10) else table_text end as csv
        from orders o left join table_text t on t.doc_id = o.o_orderkey
          left join (select doc_id, count(distinct (source_page, table_idx)) as n from cells group by doc_id) c on c.doc_id = o.o_orderkey""",
    )
)
def consolidated_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.sources.sinks import consolidated_csv as consolidate

    documents = view(spark, sf_dir, "select o_orderkey as doc_id from orders")
    return consolidate(fx.cells(spark, sf_dir), documents)


# Every order's lines as tables of their own names, so that a document has many columns.
_OWN_NAMES = f"""select doc_id, source_page, cast(table_idx * 100 + row_idx as int) as table_idx, cast(0 as int) as row_idx, col_idx,
    concat(value, cast(row_idx as varchar(9)), case when col_idx = 1 and row_idx % 2 = 0 then ',"x"' else '' end) as value from ({fx.CELLS}) c
  union all select doc_id, source_page, cast(table_idx * 100 + row_idx as int) as table_idx, cast(1 as int) as row_idx, col_idx, value from ({fx.CELLS}) c"""
_LINES = [(name, text if name != "cells" else _OWN_NAMES) for name, text in TABLE_TEXT]


def _own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_OWN_NAMES``: each cell gives its name and its value."""
    name = F.expr("concat(value, cast(row_idx as varchar(9)), case when col_idx = 1 and row_idx % 2 = 0 then ',\"x\"' else '' end)")
    table = (F.col("table_idx") * 100 + F.col("row_idx")).cast("int").alias("table_idx")
    both = F.posexplode(F.array(name, "value")).alias("row_idx", "value")
    return fx.cells(spark, sf_dir).select("doc_id", "source_page", table, "col_idx", both).select(
        "doc_id", "source_page", "table_idx", "row_idx", "col_idx", "value"
    )


@query(
    ctes(
        *_LINES,
        body="""select doc_id, row_number() over (partition by doc_id order by source_page, table_idx, row_idx) - 1 as line_no, line from csv_lines
          union all select o_orderkey, 0, 'source_page,table_id,note' from orders where o_orderkey not in (select doc_id from csv_lines)""",
    )
)
def consolidated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated table of every document by lines, of documents with many columns."""
    from claimloom.sources import sinks

    documents = view(spark, sf_dir, "select o_orderkey as doc_id from orders")
    return sinks.consolidated_lines(tables.table_lines(_own_names(spark, sf_dir)), documents)


# Another extractor that found a table in every order, also in those without lines.
_SECOND_SOURCE = """select o_orderkey as doc_id, 1 as source_page, 0 as table_idx, 0 as row_idx, 0 as col_idx, 'status' as value from orders
  union all select o_orderkey, 1, 0, 1, 0, o_orderstatus from orders"""


@query(
    ctes(
        ("cells", fx.CELLS), ("second", _SECOND_SOURCE),
        body="""select doc_id, source_page, table_idx, row_idx, col_idx, value from cells
          union all select * from second where doc_id not in (select doc_id from cells)""",
    )
)
def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_table_fallback(fx.cells(spark, sf_dir), view(spark, sf_dir, _SECOND_SOURCE))


# --- sheets and context ---------------------------------------------------------------

SHEET_TEXT = [
    ("sheet_rows", fx.SHEET_ROWS),
    ("ranked", "select *, row_number() over (partition by file, sheet_idx, sheet order by row_idx) as rn from sheet_rows"),
    ("sheet_text", f"""select file, sheet_idx, sheet, chr(10) || '=== Sheet: ' || sheet || ' ===' || chr(10) || chr(10) ||
        case when count(*) > {fixed.SHEET_ROWS + 1} then '[NOTE: Only first {fixed.SHEET_ROWS} rows shown for this sheet]' || chr(10) || chr(10) else '' end ||
        string_agg(row_text, chr(10) order by rn) filter (where rn <= {fixed.SHEET_ROWS + 1}) || chr(10) || chr(10) as text
      from ranked group by file, sheet_idx, sheet"""),
    ("book_text", "select file, string_agg(text, chr(10) order by sheet_idx) as text from sheet_text group by file"),
]


@query(ctes(*SHEET_TEXT, body="select file, sheet_idx, sheet, text from sheet_text"))
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sheet_texts(view(spark, sf_dir, fx.SHEET_ROWS))


@query(ctes(*SHEET_TEXT, body="select file, text from book_text"))
def workbook_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.workbook_texts(tables.sheet_texts(view(spark, sf_dir, fx.SHEET_ROWS)))


def first_lines_sql(x: str, limit: int, suffix: str) -> str:
    lines = f"string_split(case when {x} like '%' || chr(10) then left({x}, length({x}) - 1) else {x} end, chr(10))"
    return (
        f"case when len({lines}) > {limit} then array_to_string(list_slice({lines}, 1, {limit}), chr(10)) "
        f"|| chr(10) || '{suffix}' else {x} end"
    )


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail text, tables and sheets of each document."""
    mails = view(spark, sf_dir, fx.MAILS).withColumn("file", F.concat(F.lit("book"), (F.col("doc_id") % 60).cast("string")))
    csv = tables.table_texts(fx.cells(spark, sf_dir))
    books = tables.workbook_texts(tables.sheet_texts(view(spark, sf_dir, fx.SHEET_ROWS))).withColumnRenamed("text", "xlsx_text")
    return mails.join(csv, "doc_id", "left").join(books, "file", "left")


MATERIALS = [
    ("mails", fx.MAILS), *TABLE_TEXT, *SHEET_TEXT,
    ("materials", """select m.doc_id, raw_text, table_text, b.text as xlsx_text from mails m
      left join table_text t on m.doc_id = t.doc_id left join book_text b on b.file = 'book' || cast(m.doc_id % 60 as varchar)"""),
]
_TABLES_OR = f"coalesce(nullif(table_text, ''), '{fixed.NO_TABLE_DATA}')"
_SHEETS_OR = f"coalesce(nullif(xlsx_text, ''), '{fixed.NO_XLSX_DATA}')"
INPUTS = [
    *MATERIALS,
    ("inputs", f"""select doc_id, raw_text as email_text,
      {first_lines_sql(_TABLES_OR, fixed.CONTEXT_LINES, fixed.CONTEXT_SUFFIX)} as table_data,
      {first_lines_sql(_SHEETS_OR, fixed.CONTEXT_LINES, fixed.CONTEXT_SUFFIX)} as xlsx_data from materials"""),
]


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materials(spark, sf_dir).select(
        "doc_id", *context.model_inputs(F.col("raw_text"), F.col("table_text"), F.col("xlsx_text"))
    )


@query(
    ctes(
        *MATERIALS,
        body="select doc_id, " + sql.strip(
            "raw_text || chr(10) || chr(10) || '=== EXTRACTED TABLES ===' || chr(10) || coalesce(table_text, '')"
            " || chr(10) || chr(10) || '=== EXTRACTED XLSX ===' || chr(10) || coalesce(xlsx_text, '')"
        ) + " as context from materials",
    )
)
def full_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materials(spark, sf_dir).select(
        "doc_id", context.full_context(F.col("raw_text"), F.col("table_text"), F.col("xlsx_text")).alias("context")
    )


@query(
    f"select doc_id, {first_lines_sql('text', fixed.CONTEXT_LINES, fixed.CONTEXT_SUFFIX)} as text from documents"
)
def first_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "select doc_id, text from documents").select(
        "doc_id", first_lines(F.col("text"), fixed.CONTEXT_LINES, fixed.CONTEXT_SUFFIX).alias("text")
    )


@query(ctes(*INPUTS, body="select doc_id, email_text, table_data, xlsx_data from inputs"))
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir)


@query(
    ctes(
        *MATERIALS,
        body=f"""select doc_id, {first_lines_sql('raw_text', 100, fixed.EVALUATION_SUFFIX)} as email_text,
          {first_lines_sql(f"coalesce(table_text, '{fixed.NO_TABLE_DATA}')", 30, fixed.EVALUATION_SUFFIX)} as table_data,
          {first_lines_sql(f"coalesce(xlsx_text, '{fixed.NO_XLSX_DATA}')", 30, fixed.EVALUATION_SUFFIX)} as xlsx_data from materials""",
    )
)
def evaluation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materials(spark, sf_dir).select(
        "doc_id", *context.evaluation_inputs(F.col("raw_text"), F.col("table_text"), F.col("xlsx_text"))
    )


@query(
    ctes(
        *INPUTS,
        body="""select doc_id, length(email_text) as email_text_chars, length(table_data) as table_data_chars,
          length(xlsx_data) as xlsx_data_chars from inputs""",
    )
)
def input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.input_sizes(_inputs(spark, sf_dir))


@query(
    ctes(
        *INPUTS,
        body="select doc_id, " + ", ".join(
            f"left({c}, {n}) as {c}_preview, length({c}) > {n} as {c}_cut" for c, n in fixed.PREVIEW_CHARS.items()
        ) + " from inputs",
    )
)
def input_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.previews(_inputs(spark, sf_dir))


_DEMOS = "select text as email_text from conversations"


@query(
    ctes(
        ("demos", _DEMOS),
        body="select count(*) as num_demos, cast(coalesce(sum(length(email_text)), 0) as bigint) as input_chars, count(*) > 0 as few_shot from demos",
    )
)
def demonstration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.demonstration_profile(view(spark, sf_dir, _DEMOS))


_DEMO_ROWS = "select case when turn % 4 = 0 then null else text end as email_text, text as reasoning, role as scheme_type, cast(null as varchar(9)) as scheme_subtype from conversations"


@query(
    ctes(
        ("demos", _DEMO_ROWS),
        body="""select left(coalesce(email_text, 'N/A'), 200) as email_text, left(coalesce(reasoning, 'N/A'), 300) as reasoning,
          coalesce(scheme_type, 'N/A') as scheme_type, coalesce(scheme_subtype, 'N/A') as scheme_subtype from demos""",
    )
)
def demonstration_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.demonstration_previews(view(spark, sf_dir, _DEMO_ROWS))


_TABLE_REPORT = f"""select doc_id, source_page, table_idx, count(distinct row_idx) - 1 as num_rows, count(distinct col_idx) as num_columns
  from ({fx.CELLS}) t group by doc_id, source_page, table_idx"""


@query(
    ctes(
        ("t", _TABLE_REPORT),
        body=f"""select *, row_number() over (partition by doc_id order by source_page, table_idx) as rank from t
          qualify rank <= {fixed.REPORTED_TABLES}""",
    )
)
def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = context.first_rows(
        view(spark, sf_dir, _TABLE_REPORT), ["doc_id"], ["source_page", "table_idx"], fixed.REPORTED_TABLES
    )
    return report.withColumn("rank", F.col("rank").cast("bigint"))


_REMOVALS = [("mails", fx.MAILS), *sql.cleaning()]


@query(
    ctes(
        *_REMOVALS,
        body=f"""select doc_id, row_number() over (partition by doc_id order by paragraph_no) as item_no, class as category,
          substr(p, 1, 60) as text_preview from classes where class in ('header', 'footer', 'disclaimer')
          qualify item_no <= {fixed.REPORTED_REMOVALS}""",
    )
)
def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.operators import clean

    return context.removal_report(clean.with_paragraphs(view(spark, sf_dir, fx.MAILS)))
