"""Views over the given tables that stand in for the inputs of the operators.

One SQL text serves Spark and the comparison database, so both read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

MAILS = r"""
select doc_id, source,
  concat('From: ', source, ' <', source, '@vendor.example>', chr(10),
    case when doc_id % 3 = 0 then concat('To: buyer@shop.example,', chr(10), 'second@shop.example', chr(10)) else '' end,
    case when doc_id % 2 = 0 then concat('Cc: a@shop.example,', chr(10), 'b@shop.example;', chr(10)) else '' end,
    'Subject: offer ', cast(doc_id as varchar(20)), chr(10), chr(10),
    case doc_id % 7 when 0 then 'price drop effective from 24/06/2024 for sku X-100'
      when 1 then 'sor pricing for apparel' when 2 then 'jbp support plan'
      when 3 then 'one-off sales support' when 4 then 'prexo bumpup offer'
      else 'sellout support of 5% on units' end, chr(10), chr(10),
    case when doc_id % 4 = 0 then concat('| a | b |', chr(10), '| 1 | 2 |', chr(10), chr(10)) else '' end,
    replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
    case when doc_id % 5 = 0 then 'This e-mail message may contain confidential data. Any copying is strictly prohibited. '
      when doc_id % 5 = 1 then 'The recipient accepts liability for viruses and damages'
      else 'Regards' end, chr(10), chr(10), '1/3') as raw_text
from documents
"""

PREDICTIONS = r"""
select doc_id,
  case when doc_id % 11 = 0 then 'OTHER' when doc_id % 5 = 0 then 'BUY_SIDE' when doc_id % 5 = 1 then 'SELL_SIDE' when doc_id % 5 = 2 then 'OFC' when doc_id % 5 = 3 then 'PDC' else null end as scheme_type,
  case doc_id % 8 when 0 then 'PERIODIC_CLAIM' when 1 then 'CP' when 2 then 'PUC' when 3 then 'PRX' when 4 then 'SC' when 5 then 'LS' when 6 then 'PDC' else 'BOC' end as scheme_subtype,
  case doc_id % 9 when 0 then concat('Supplier#', lpad(cast(doc_id % 10 as varchar(20)), 9, '0')) when 1 then 'Titan Company Ltd' when 2 then null when 3 then '00001' else 'Unknown Vendor' end as vendor_name,
  case doc_id % 9 when 0 then '01/02/2024' when 1 then '2024-02-01' when 2 then '1-2-2024' when 3 then '5 Jan 2024' when 4 then 'January 5, 2024' when 5 then 'Not Specified' when 6 then 'valid until 3/4/2024 only' when 7 then 'soon' else null end as start_date,
  case when doc_id % 4 = 0 then '01/02/2024 to 10/02/2024; 11/02/2024 to 20/02/2024' else 'Single Period' end as sub_periods,
  case when doc_id % 4 = 1 then 'ACCFGH1234567890;ACCFGH1234567891, short' else 'None' end as extracted_fsns,
  case doc_id % 3 when 0 then 'red widget' when 1 then 'BLUEbolt' else 'widget' end as model_name,
  case when doc_id % 2 = 0 then '5% of NLC' else '' end as config_brand_support,
  case when doc_id % 2 = 0 then 'short reason' else 'a long reason that is certainly more than fifty characters in total' end as reasoning
from documents
"""

FSN_MAPPING = r"""
select p_partkey as row_idx, p_name as model_name, concat(p_brand, ' ', p_name) as title, concat('FSN', lpad(cast(p_partkey as varchar(20)), 13, '0')) as fsn from part
"""

BRAND_MAPPING = r"""
select s_suppkey as row_idx, case when s_suppkey % 2 = 0 then s_name else concat(' ', replace(s_name, '#', ' # ')) end as brand,
  case s_suppkey % 4 when 0 then '30%' when 1 then 'DMRP is 40%' when 2 then '-' else '250' end as dmrp_details,
  case s_suppkey % 3 when 0 then '0.37' when 1 then '12.5%' else null end as margin, concat('SITE_', cast(s_nationkey as varchar(20))) as sc from supplier
"""

MESSAGES = "select conv_id, turn, role, text from conversations"

STAGE_LOG = "select user_id as doc_id, event_type as stage, ts, value as duration, event_id from events"

_LINES = """(select l.*, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) as int) as rn from lineitem l) t"""

ELEMENTS = f"""
select l_orderkey as doc_id, cast(rn % 3 + 1 as int) as page, rn as seq,
  case rn % 4 when 0 then 'image' when 1 then 'char' when 2 then 'line' else 'rect' end as object_type,
  l_quantity * 10 as x0, cast(l_suppkey % 80 * 10 as double) as top, l_returnflag as text
from {_LINES}
"""

ZONES = """
select distinct l_orderkey as doc_id, cast(l_linenumber % 3 + 1 as int) as page, 0.0e0 as x0, 0.0e0 as top, 600.0e0 as x1, 50.0e0 as bottom from lineitem
union all select distinct l_orderkey, cast(l_linenumber % 3 + 1 as int), 100.0e0, 200.0e0, 300.0e0, 400.0e0 from lineitem where l_orderkey % 2 = 0
"""

TABLE_BOXES = """
select distinct l_orderkey as doc_id, cast(l_linenumber % 3 + 1 as int) as page, 100.0e0 as x0, 200.0e0 as top, 300.0e0 as x1, 400.0e0 as bottom from lineitem where l_orderkey % 2 = 0
"""

PAGE_SIZES = """
select distinct l_orderkey as doc_id, cast(l_linenumber % 3 + 1 as int) as page, 600.0e0 as width, cast(800 + l_orderkey % 5 * 10 as double) as height from lineitem
"""

# Page texts of one document per source folder, with some empty and blank pages.
PAGE_TEXTS = """
select cast(floor(doc_id / 5) as bigint) as doc_id, cast(doc_id % 5 + 1 as int) as page,
  case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then '  ' else text end as text
from documents
"""

CELLS = f"""
select l_orderkey as doc_id, 1 as source_page, cast((rn - 1) % 2 as int) as table_idx, cast(floor((rn - 1) / 2) as int) as row_idx, 0 as col_idx, l_returnflag as value from {_LINES}
union all select l_orderkey as doc_id, 1 as source_page, cast((rn - 1) % 2 as int) as table_idx, cast(floor((rn - 1) / 2) as int) as row_idx, 1 as col_idx, l_linestatus as value from {_LINES}
"""

# The lines of CELLS once: one window in place of one for each column.
_CELL_LINES = f"""select l_orderkey as doc_id, 1 as source_page, cast((rn - 1) % 2 as int) as table_idx, cast(floor((rn - 1) / 2) as int) as row_idx,
  l_returnflag, l_linestatus from {_LINES}"""

SHEET_ROWS = """
select concat('book', cast(o_custkey % 50 as varchar(20))) as file, cast(substring(o_orderpriority, 1, 1) as int) as sheet_idx, o_orderpriority as sheet, o_orderkey as row_idx, concat(cast(o_orderkey as varchar(20)), ' | ', o_orderstatus) as row_text from orders
"""

GOLD = """
select doc_id as example_id,
  case doc_id % 6 when 0 then 'BS' when 1 then 'sell side' when 2 then 'one off' else 'PDC-PDC' end as scheme_type,
  case doc_id % 8 when 0 then 'BS-PC' when 1 then 'coupon' when 2 then 'PUC_FDC' else 'SS-LS' end as scheme_subtype,
  case doc_id % 3 when 0 then '01/02/2024 - 10/02/2024' when 1 then 'n/a' else '01/02/2024  to  10/02/2024' end as duration
from documents
"""

FILES = """
select page_id as file_id, concat('/in/', cast(page_id % 20 as varchar(20)), '/f', cast(page_id as varchar(20)), case page_id % 4 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.xlsx' else '.txt' end) as path from pages
"""

FILE_METRICS = """
select o_orderkey as doc_id, case when o_orderstatus = 'F' then 'failed' else 'success' end as status,
  case when o_orderkey % 3 = 0 then 'openrouter/qwen/qwen3-32b' when o_orderkey % 3 = 1 then 'openai/gpt-4o-mini' else 'some/new-model' end as model,
  o_custkey % 5000 as input_tokens, o_orderkey % 900 as output_tokens from orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view's SQL over the tables of a folder."""
    for name in TABLES:
        if f"from {name}" in sql:
            data = table(spark, sf_dir, name)
            # Text work is heavy per row and the test tables are single files.
            data = spread(data) if name == "documents" else data
            data.createOrReplaceTempView(name)
    return spark.sql(sql)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``CELLS``: the lines are numbered once, and each gives its two cells."""
    values = F.posexplode(F.array("l_returnflag", "l_linestatus")).alias("col_idx", "value")
    return view(spark, sf_dir, _CELL_LINES).select("doc_id", "source_page", "table_idx", "row_idx", values)
