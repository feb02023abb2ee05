"""Queries through the readers and sinks: rows are written as files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.operators import evaluate, usage
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries import usage as usage_queries
from claimloom.queries.fixtures import view
from claimloom.queries.layout import first_lines_sql
from claimloom.queries.registry import ctes, query
from claimloom.queries.sources import _RECORDS
from claimloom.session import new_folder
from claimloom.sources import files, readers, sinks

# A text in a file, in a file that is not there, in the example itself, or none at all.
_EXAMPLES = """select doc_id, text, case doc_id % 4 when 0 then concat('texts/mail ', cast(doc_id as varchar(20)), '+.txt')
    when 1 then concat('gone/', cast(doc_id as varchar(20)), '.md') else '' end as input_file,
  case when doc_id % 4 = 2 then text end as input, case when doc_id % 5 = 0 then text end as table_data, lang, source from documents"""
_LABELLED = f"""select row_number() over (order by doc_id) - 1 as example_id,
    case doc_id % 4 when 0 then {first_lines_sql(sql.strip('text'), 100, fixed.EVALUATION_SUFFIX)} when 1 then input_file
      when 2 then {first_lines_sql('text', 100, fixed.EVALUATION_SUFFIX)} else '' end as email_text,
    {first_lines_sql(f"coalesce(table_data, '{fixed.NO_TABLE_DATA}')", 30, fixed.EVALUATION_SUFFIX)} as table_data,
    '{fixed.NO_XLSX_DATA}' as xlsx_data, source as vendor, lang as language from examples"""


def _write_examples(spark: SparkSession, sf_dir: str) -> str:
    """Examples in three files, in order of their ids, and the texts beside them; the folder."""
    folder = new_folder(spark, "gold")
    given = view(spark, sf_dir, _EXAMPLES)
    named = given.where("doc_id % 4 = 0").select(F.col("input_file").alias("name"), "text")
    sinks.write_files(named, folder).agg(F.sum("n_bytes")).collect()
    labels = F.create_map(F.lit("Vendor"), F.col("source"), F.lit("Language"), F.col("lang"))
    rows = given.select("doc_id", "input_file", "input", "table_data", labels.alias("labels"))
    rows.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(f"{folder}/examples.jsonl")
    return folder


@query(ctes(("examples", _EXAMPLES), body=_LABELLED))
def labelled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write_examples(spark, sf_dir)
    gold = readers.read_gold(spark, f"{folder}/examples.jsonl", folder)
    return gold.select(
        "example_id", "email_text", "table_data", "xlsx_data",
        F.col("labels")["Vendor"].alias("vendor"), F.col("labels")["Language"].alias("language"),
    )


@query(
    ctes(
        ("examples", _EXAMPLES),
        body="select 'train' as part, count(*) as examples, count(distinct source) as vendors from examples union all select 'validation', 0, 0",
    )
)
def train_and_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of examples, of which one has no file."""
    folder = _write_examples(spark, sf_dir)
    parts = {"train": "examples.jsonl", "validation": "absent.jsonl"}
    counts = [
        readers.read_gold(spark, f"{folder}/{file}", folder).agg(
            F.lit(part).alias("part"), F.count("*").alias("examples"), F.count_distinct(F.col("labels")["Vendor"]).alias("vendors")
        )
        for part, file in parts.items()
    ]
    return counts[0].unionByName(counts[1])


@query(ctes(("examples", _EXAMPLES), body="select regexp_extract(input_file, '[^/]*$') as name, text from examples where doc_id % 4 = 0"))
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read back as UTF-8."""
    folder = _write_examples(spark, sf_dir)
    return readers.read_text(spark, f"{folder}/texts", "*.txt").select(files.file_name(F.col("path")).alias("name"), "text")


@query(
    ctes(
        ("m", fx.FSN_MAPPING),
        body="select row_number() over (order by row_idx) - 1 as row_idx, model_name, title, fsn from m",
    )
)
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of three files without row numbers, read back with them."""
    path = new_folder(spark, "mapping")
    names = {"model_name": "Model Name", "title": "Title", "fsn": "FSN"}
    rows = view(spark, sf_dir, fx.FSN_MAPPING).repartitionByRange(3, "row_idx").sortWithinPartitions("row_idx")
    rows.select(*[F.col(c).alias(name) for c, name in names.items()]).write.csv(path, header=True)
    return readers.read_mapping(spark, path, "`Model Name` string, Title string, FSN string").select("row_idx", "model_name", "title", "fsn")


# A saved program for each of fifty numbers, one of them cut off.
_DEMOS = "select conv_id % 50 as k, text as email_text, role as reasoning, concat('turn ', cast(turn as varchar(20))) as scheme_type from conversations"


@query(
    ctes(
        ("demos", _DEMOS),
        body="""select k, email_text, reasoning, scheme_type, cast(null as varchar) as error from demos where k <> 7
          union all select distinct 7::bigint, null, null, null, 'the file cannot be read' from demos where k = 7""",
    )
)
def saved_demonstrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "saved")
    demos = view(spark, sf_dir, _DEMOS).groupBy("k").agg(F.collect_list(F.struct("email_text", "reasoning", "scheme_type")).alias("demos"))
    whole = F.to_json(F.struct(F.struct("demos").alias("predict")))
    saved = demos.select("k", F.when(F.col("k") == 7, F.left(whole, F.length(whole) - 5)).otherwise(whole).alias("value"))
    saved.repartition("k").write.partitionBy("k").text(path)
    read = readers.read_saved(spark, path).withColumn("k", F.regexp_extract("path", "k=(\\d+)/", 1).cast("bigint"))
    return read.select("k", "error", F.explode_outer("demos").alias("d")).select(
        "k", "d.email_text", "d.reasoning", "d.scheme_type", "error"
    )


@query(
    ctes(
        ("mails", fx.MAILS),
        body="""select m.doc_id, 'raw_text' as stage, raw_text as text from mails m
          union all select doc_id, 'source_text', text from documents""",
    )
)
def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two stages."""
    texts = view(spark, sf_dir, fx.MAILS).join(view(spark, sf_dir, "select doc_id, text as source_text from documents"), "doc_id")
    output = sinks.Output(spark, new_folder(spark, "texts"))
    sinks.write_texts(texts, output, ["raw_text", "source_text"])
    output.commit()
    return readers.read_table(spark, output.path, "texts").select("doc_id", "stage", "text")


_PAGE_RECORDS = f"select r.*, p.url from ({_RECORDS}) r join pages p on p.page_id = r.doc_id"


@query(
    ctes(
        ("r", _PAGE_RECORDS),
        body="""select stem || '_config' || case when num_periods > 1 then '_P' || period_no else '' end as name, doc_id, url, num_periods from r""",
    )
)
def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration records; a later run that was cut off before its end does not count."""
    path = new_folder(spark, "records")
    name = sinks.config_file(F.col("stem"), F.col("period_no"), F.col("num_periods"))
    record = F.to_json(F.struct("url", "num_periods"))
    records = view(spark, sf_dir, _PAGE_RECORDS).select("doc_id", name.alias("name"), record.alias("config"))
    whole, cut_off = sinks.Output(spark, path), sinks.Output(spark, path)
    sinks.write_records(records, whole, "configs", "config")
    whole.commit()
    sinks.write_records(records.limit(1), cut_off, "configs", "config")
    read = readers.read_table(spark, path, "configs", "json")
    return read.withColumn("r", F.from_json("record", "url string, num_periods bigint")).select("name", "doc_id", "r.url", "r.num_periods")


def _write_summary(spark: SparkSession, sf_dir: str) -> str:
    metrics = usage.with_cost(view(spark, sf_dir, fx.FILE_METRICS))
    output = sinks.Output(spark, new_folder(spark, "summary"))
    sinks.write_summary(usage.batch_totals(metrics), metrics, metrics.select("doc_id", "status"), output)
    output.commit()
    return output.path


@query(ctes(("file_metrics", fx.FILE_METRICS), usage_queries.PRICES, usage_queries.costed("file_metrics"), body=usage_queries.totals_sql("costed")))
def written_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = usage.batch_totals(view(spark, sf_dir, fx.FILE_METRICS).withColumn("cost", F.lit(0.0))).columns
    return readers.read_table(spark, _write_summary(spark, sf_dir), "summary", "json").select(*names)


@query(
    ctes(
        ("file_metrics", fx.FILE_METRICS), usage_queries.PRICES, usage_queries.costed("file_metrics"),
        body="select doc_id, status, model, total_tokens, round(cost, 9) as cost from costed",
    )
)
def written_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.read_table(spark, _write_summary(spark, sf_dir), "per_file_metrics", "json")
    return read.select("doc_id", "status", "model", "total_tokens", F.round("cost", 9).alias("cost"))


# A label that is there without a value, one that is absent, and one with a value.
_NULL_LABELS = "select doc_id, case when doc_id % 3 = 0 then lang end as v, doc_id % 3 < 2 as present from documents"


@query(ctes(("l", _NULL_LABELS), body="select doc_id, case when not present then '' when v is null then 'none' else lower(v) end as vendor_name from l"))
def null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = view(spark, sf_dir, _NULL_LABELS)
    none = F.create_map().cast("map<string,string>")
    labels = F.when(F.col("present"), F.create_map(F.lit("Vendor"), F.col("v"))).otherwise(none)
    columns = evaluate.label_columns(given.select("doc_id", labels.alias("labels")))
    return columns.select("doc_id", evaluate.plain(F.col("vendor_name")).alias("vendor_name"))
