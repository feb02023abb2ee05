"""Queries over input files, attachments and output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.queries import fixtures as fx
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query
from claimloom.sources import files, sinks

PARENT = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1')"
FOUND = [
    ("files", fx.FILES),
    ("found", "select *, case when path like '%.pdf' then 'document' when path like '%.xlsx' or path like '%.xls' then 'workbook' end as kind from files where path like '%.pdf' or path like '%.xlsx' or path like '%.xls'"),
]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover(view(spark, sf_dir, fx.FILES))


@query(ctes(*FOUND, body="select file_id, path, kind from found"))
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(
    ctes(
        ("files", fx.FILES),
        body="""select file_id, path, case when lower(path) like '%.pdf' then 'document' else 'workbook' end as kind
          from files where lower(path) like '%.pdf' or lower(path) like '%.xls' or lower(path) like '%.xlsx'""",
    )
)
def single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file as if it were the only input."""
    return files.discover(view(spark, sf_dir, fx.FILES), single_file=True)


# Documents and workbooks in the same folders.
_MIXED = """select page_id as file_id, concat('/in/', cast(page_id % 10 as varchar(20)), '/f', cast(page_id as varchar(20)),
  case when page_id % 30 < 12 then '.pdf' when page_id % 30 < 22 then '.xlsx' else '.xls' end) as path from pages"""


@query(
    ctes(
        ("files", _MIXED),
        ("books", f"select {PARENT} as folder, count(*) as n from files where path like '%.xls%' group by folder"),
        body=f"""select f.file_id, f.path, f.folder, coalesce(n, 0) as num_workbooks
          from (select *, {PARENT} as folder from files where path like '%.pdf') f left join books b on f.folder = b.folder""",
    )
)
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_attachments(files.discover(view(spark, sf_dir, _MIXED)))


@query(ctes(("files", _MIXED), body=f"select {PARENT} as folder, path as workbook from files where path like '%.xls%'"))
def folder_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.workbooks_by_folder(files.discover(view(spark, sf_dir, _MIXED)))


@query(
    ctes(
        *FOUND,
        body=f"""select file_id, case when {PARENT} = '/in/3' then {STEM} else regexp_extract({PARENT}, '([^/]*)$', 1) end || '_01022024_101112' as name
          from found where kind = 'document' or file_id >= 0""",
    )
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(
        "file_id", files.output_name(F.col("path"), "/in/3", "01022024_101112").alias("name")
    )


@query(ctes(*FOUND, body=f"select case when count(*) filter (where kind = 'document') = 1 then max({STEM}) filter (where kind = 'document') else '' end as prefix from found"))
def output_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.output_prefix(_found(spark, sf_dir))


_STAMPS = "select event_id, ts, case when event_id % 3 = 0 then '' else event_type end as prefix from events"


@query(
    ctes(
        ("s", _STAMPS),
        body="select event_id, case when prefix = '' then strftime(ts, '%d%m%Y%H%M') else prefix || '_' || strftime(ts, '%d%m%Y%H%M') end as folder from s",
    )
)
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _STAMPS).select("event_id", files.folder_name(F.col("prefix"), F.col("ts")).alias("folder"))


_RECORDS = "select page_id as doc_id, concat('mail', cast(page_id as varchar(20))) as stem, page_id % 3 + 1 as num_periods, page_id % 2 + 1 as period_no from pages"


@query(
    ctes(
        ("r", _RECORDS),
        body="""select doc_id, stem || '_output' as output, stem || '_reasoning' as reasoning,
          stem || '_config' || case when num_periods > 1 then '_P' || period_no else '' end as config from r""",
    )
)
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.col("stem")
    return view(spark, sf_dir, _RECORDS).select(
        "doc_id",
        sinks.output_file(stem, "output").alias("output"),
        sinks.output_file(stem, "reasoning").alias("reasoning"),
        sinks.config_file(stem, F.col("period_no"), F.col("num_periods")).alias("config"),
    )
