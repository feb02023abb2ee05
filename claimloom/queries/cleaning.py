"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.normalise import normalise
from claimloom.functions.text import paragraphs
from claimloom.operators import clean
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import MAILS, view
from claimloom.queries.registry import ctes, query

mails_cte = ("mails", MAILS)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MAILS)


# Compatibility characters, invisible ones, line separators and control characters.
_NOISE = ["Ａ①ﬁ™ Café ₹5", "in​voice­﻿", " x‑y z", "a\x07b\x7f\tc"]
_CLEAN = ["A1fiTM Café ₹5", "invoice", " x‐y\nz", "ab\tc"]


def _noisy(prefixes: list[str]) -> str:
    cases = " ".join(f"when {i} then '{p}'" for i, p in enumerate(prefixes))
    return f"select doc_id, concat(case doc_id % 4 {cases} end, text) as text from documents"


@query(_noisy(_CLEAN))
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _noisy(_NOISE)).select("doc_id", normalise(F.col("text")).alias("text"))


@query(ctes(mails_cte, *sql.cc_blocks("mails", "raw_text"), body="select doc_id, text, starts from cc"))
def cc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", clean.without_cc_blocks(F.col("raw_text")).alias("r")
    ).select("doc_id", "r.text", "r.starts")


@query(ctes(mails_cte, *sql.address_blocks("mails", "raw_text"), body="select doc_id, text, starts from address"))
def address_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", clean.without_address_blocks(F.col("raw_text")).alias("r")
    ).select("doc_id", "r.text", "r.starts")


# Threads with several disclaimers, one without an ending.
_THREADS = r"""
select doc_id, concat(
  case when doc_id % 3 = 0 then 'This email and any files transmitted with it are confidential. Copying is STRICTLY PROHIBITED by law. ' else '' end,
  text, chr(10),
  case when doc_id % 2 = 0 then 'Any views or opinions presented in this email are solely those of the author; the employee will be personally liable for any damages or other liability arising' else 'Best regards' end, chr(10),
  'second mail ', text,
  case doc_id % 4 when 0 then ' this EMAIL holds confidential data and is legally protected' when 1 then ' This message contains confidential information.' else '' end) as raw_text
from documents
"""


@query(
    ctes(
        ("threads", _THREADS),
        *sql.disclaimer_blocks("threads", "raw_text"),
        body="select doc_id, text, cast(blocks as bigint) as blocks from block",
    )
)
def disclaimer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _THREADS).select(
        "doc_id", clean.without_disclaimer_blocks(F.col("raw_text")).alias("r")
    ).select("doc_id", "r.text", "r.blocks")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select("doc_id", F.posexplode(paragraphs(F.col("raw_text"))).alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("paragraph_no"), "p"
    )


@query(
    ctes(
        mails_cte, *sql.paragraphs("mails", "raw_text"),
        body="select doc_id, paragraph_no, p as paragraph from paragraphs",
    )
)
def mail_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).withColumnRenamed("p", "paragraph")


def _flagged(test: str) -> str:
    return ctes(
        mails_cte, *sql.paragraphs("mails", "raw_text"),
        body=f"select doc_id, paragraph_no, {test} as flag from paragraphs",
    )


def _flags(spark: SparkSession, sf_dir: str, test) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id",
        F.posexplode(F.transform(paragraphs(F.col("raw_text")), test)).alias("pos", "flag"),
    ).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("paragraph_no"), "flag")


@query(_flagged(sql.IS_TABLE))
def table_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, clean.is_table)


@query(_flagged(sql.IS_PROTECTED))
def protected_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, clean.is_protected)


@query(_flagged(sql.IS_HEADER))
def header_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, clean.is_header)


@query(_flagged(sql.IS_FOOTER))
def footer_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, clean.is_footer)


@query(_flagged(sql.IS_DISCLAIMER))
def disclaimer_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, clean.is_disclaimer)


_CLEANING = [mails_cte, *sql.cleaning()]


@query(ctes(*_CLEANING, body="select doc_id, cleaned_text from cleaned"))
def clean_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(mails(spark, sf_dir)).select("doc_id", "cleaned_text")


def _reduction(digits: int) -> str:
    share = "(length(raw_text) - length(cleaned_text)) / length(raw_text) * 100.0"
    return f"case when length(raw_text) > 0 then {sql.rounded(share, digits)} else 0.0 end"


@query(
    ctes(
        *_CLEANING,
        body="select doc_id, length(raw_text) as original_length, length(cleaned_text) as cleaned_length, "
        "length(raw_text) - length(cleaned_text) as reduction_chars, "
        f"{_reduction(2)} as reduction_percent from cleaned",
    )
)
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(mails(spark, sf_dir)).select(
        "doc_id", *clean.size_statistics(F.col("raw_text"), F.col("cleaned_text"))
    )


@query(ctes(*_CLEANING, body=f"select doc_id, {_reduction(1)} as reduction_percent from cleaned"))
def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean(mails(spark, sf_dir))
    return cleaned.select(
        "doc_id",
        clean.reduction_percent(F.length("raw_text"), F.length("cleaned_text"), 1).alias("reduction_percent"),
    )


@query(
    ctes(
        *_CLEANING,
        (
            "counts",
            "select doc_id, " + ", ".join(
                f"count(*) filter (where class = '{c}') as n_{c}"
                for c in ("table", "protected", "header", "footer", "disclaimer", "body")
            ) + " from classes group by doc_id",
        ),
        body="""select m.doc_id, cc.starts as cc_blocks, address.starts as address_blocks, cast(block.blocks as bigint) as disclaimer_blocks,
          coalesce(n_header, 0) as header_paragraphs, coalesce(n_footer, 0) as footer_paragraphs,
          coalesce(n_disclaimer, 0) as disclaimer_paragraphs, coalesce(n_body, 0) as body_paragraphs,
          cast(cc.starts + address.starts + block.blocks + coalesce(n_header + n_footer + n_disclaimer, 0) as bigint) as removed,
          coalesce(n_table + n_protected + n_body + n_disclaimer, 0) as retained,
          coalesce(n_protected, 0) as protected, coalesce(n_table, 0) as tables_protected
        from mails m join cc on m.doc_id = cc.doc_id join address on m.doc_id = address.doc_id
          join block on m.doc_id = block.doc_id left join counts c on m.doc_id = c.doc_id""",
    )
)
def cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.audit_counts(clean.with_paragraphs(mails(spark, sf_dir)))


@query(
    ctes(
        *_CLEANING,
        body=f"""select doc_id, row_number() over (partition by doc_id order by paragraph_no) - 1 as hit_no,
          substr(p, 1, 100) as text_preview, array_to_string(list_sort({sql.KEYWORDS}), '; ') as keywords_found,
          len({sql.KEYWORDS}) as keyword_count
        from classes where class = 'disclaimer' and len({sql.KEYWORDS}) >= {fixed.DISCLAIMER_KEYWORD_MINIMUM}""",
    )
)
def keyword_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = clean.keyword_report(clean.with_paragraphs(mails(spark, sf_dir)))
    return report.withColumn("keywords_found", F.array_join("keywords_found", "; "))


@query(
    ctes(
        mails_cte,
        *sql.cc_blocks("mails", "raw_text"),
        *sql.paragraphs("cc", "text"),
        (
            "tested",
            f"select *, case when {sql.IS_HEADER} then 'header' when {sql.IS_FOOTER} then 'footer' else 'body' end as class from paragraphs",
        ),
        (
            "sums",
            "select doc_id, string_agg(p, chr(10) || chr(10) order by paragraph_no) filter (where class = 'body') as kept, "
            "count(*) filter (where class = 'header') as h, count(*) filter (where class = 'footer') as f from tested group by doc_id",
        ),
        body="""select cc.doc_id, coalesce(kept, '') as cleaned_text, starts as cc_blocks_removed,
          coalesce(h, 0) as headers_removed, coalesce(f, 0) as footers_removed, coalesce(h + f, 0) as paragraphs_removed
        from cc left join sums on cc.doc_id = sums.doc_id""",
    )
)
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_headers(mails(spark, sf_dir)).drop("source", "raw_text")


@query(
    ctes(
        mails_cte,
        *sql.disclaimer_blocks(
            "mails", "raw_text", "block", fixed.STANDALONE_BLOCK_MARKERS, fixed.STANDALONE_BLOCK_ENDINGS
        ),
        *sql.paragraphs("block", "text"),
        ("tested", f"select *, {sql.IS_DISCLAIMER} as gone from paragraphs"),
        (
            "sums",
            "select doc_id, string_agg(p, chr(10) || chr(10) order by paragraph_no) filter (where not gone) as kept, "
            "count(*) filter (where gone) as d from tested group by doc_id",
        ),
        body="""select block.doc_id, coalesce(kept, '') as cleaned_text,
          cast(blocks as bigint) as disclaimer_blocks_removed, coalesce(d, 0) as disclaimers_removed
        from block left join sums on block.doc_id = sums.doc_id""",
    )
)
def clean_disclaimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_disclaimers(mails(spark, sf_dir)).drop("source", "raw_text")


@query(
    ctes(
        *_CLEANING,
        (
            "sizes",
            "select c.doc_id, source, length(c.raw_text) as before, length(cleaned_text) as after "
            "from cleaned c join mails m on c.doc_id = m.doc_id",
        ),
        (
            "counts",
            "select source, " + ", ".join(
                f"count(*) filter (where class = '{c}') as {c}_paragraphs"
                for c in ("table", "protected", "header", "footer", "disclaimer", "body")
            ) + " from classes c join mails m on c.doc_id = m.doc_id group by source",
        ),
        body=f"""select s.source, count(*) as documents, cast(sum(before) as bigint) as original_chars,
          cast(sum(after) as bigint) as cleaned_chars,
          {sql.rounded('sum(before - after) / sum(before) * 100.0', 2)} as reduction_percent,
          {', '.join(f'any_value({c}_paragraphs) as {c}_paragraphs' for c in ('table', 'protected', 'header', 'footer', 'disclaimer', 'body'))}
        from sizes s left join counts c on s.source = c.source group by s.source""",
    )
)
def cleaning_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean(mails(spark, sf_dir))
    kinds = (clean.TABLE, clean.PROTECTED_TEXT, clean.HEADER, clean.FOOTER_TEXT, clean.DISCLAIMER, clean.BODY)
    sizes = cleaned.select(
        "source",
        F.length("raw_text").cast("bigint").alias("before"),
        F.length("cleaned_text").cast("bigint").alias("after"),
        *[clean.count_class(F.col("paragraphs"), k).alias(k) for k in kinds],
    )
    return (
        sizes.groupBy("source")
        .agg(
            F.count("*").alias("documents"),
            F.sum("before").alias("original_chars"),
            F.sum("after").alias("cleaned_chars"),
            *[F.sum(k).alias(f"{k}_paragraphs") for k in kinds],
        )
        .withColumn(
            "reduction_percent", clean.reduction_percent(F.col("original_chars"), F.col("cleaned_chars"), 2)
        )
    )
